"""Vectorised word kernels over the UTF-8 buffers of Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+``. All six separators are single bytes in UTF-8, so words are found on bytes without decoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_R = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
#: Longer words are hashed one by one.
_LONG = 48
#: Text handled at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20


class Words(NamedTuple):
    """Words of a run of documents: byte spans in ``data`` and, per document, the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # one more than documents: words of document i are firsts[i]:firsts[i + 1]
    offsets: np.ndarray  # bytes of document i are offsets[i]:offsets[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``limit`` bytes of text each."""
    _, offsets = text_buffers(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to
        at = to


def words(column: pa.Array) -> Words:
    data, offsets = text_buffers(column)
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    inside = ~SPACE[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets), offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    sizes = ends - starts
    clipped = np.minimum(sizes, _LONG + 1).astype(np.uint8)
    order = np.argsort(clipped, kind="stable")[::-1]
    live, h = starts[order], np.full(len(starts), 0x5851F42D4C957F2D, np.uint64)
    reach = np.searchsorted(-clipped[order].astype(np.int64), -np.arange(_LONG + 1), side="left")
    for j in range(_LONG + 1):
        k = reach[j]  # spans longer than j
        if not k:
            break
        h[:k] = h[:k] * _R + _TABLE[data[live[:k] + j]]
    out = np.empty_like(h)
    out[order] = h
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` neighbours in ``h``; the last n - 1 places have none."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = h[:size].copy()
    for j in range(1, n):
        out = mix(out * _R + h[j : j + size])
    return out


def within(w: Words, n: int) -> np.ndarray:
    """The first words of all runs of ``n`` words that lie in one document."""
    size = len(w.starts) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(len(w.starts), bool)
    last = w.firsts[1:]
    for j in range(1, n):
        cut = last - j
        cut = cut[cut >= w.firsts[:-1]]
        ok[cut] = False
    return np.flatnonzero(ok[:size])


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over consecutive ranges."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]

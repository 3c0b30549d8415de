"""Token ids of whole texts, equal to what the ``tokenizers`` library gives, with each distinct word encoded once.

A text is cut before every white-space run, and between a Latin letter and an ASCII mark after it. The pre-tokenizers of byte-level BPE vocabularies always have a
boundary there, so chunks can be encoded apart and their ids joined. A text with one of U+001C-U+001F, which Python counts as white space and the library
does not, is encoded whole. U+0130 is no letter here: in lower case it is two characters, and the second is a mark that goes with the ASCII mark after it.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

_WORD = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]++(?=[!-/:-@\[-`{-~])"
_SPACED, _BARE = re.compile(rf"\s*+(?:{_WORD}|\S+)|\s+"), re.compile(rf"{_WORD}|\S+")
_ODD = re.compile("[\x1c-\x1f]")


class _Index(dict):
    """Chunk to number, in order of meeting."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.fresh.append(chunk)
        return at


class _Store:
    """Id lists one after another."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[at] - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def put(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * need - self.used, np.uint32)])
        self.flat[self.used : need] = ids
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.sizes[places] = sizes
        self.used = need


class ChunkEncoder:
    """``keep_space``: chunks keep the white space before them; False for vocabularies that drop it. ``cached``: chunks of a generation; two are held."""

    def __init__(self, path: str, keep_space: bool = True, cached: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.pattern = _SPACED if keep_space else _BARE
        # Chunks of the generation before are taken over as they are met again.
        self.index, self.store = _Index(), _Store()
        self.old_index, self.old_store = _Index(), _Store()

    def _learn(self) -> None:
        store, fresh = self.store, self.index.fresh
        if not fresh:
            return
        base = len(store.starts)
        grown = np.zeros(len(fresh), np.int64)
        store.starts, store.sizes = np.concatenate([store.starts, grown]), np.concatenate([store.sizes, grown])
        was = np.fromiter(map(self.old_index.get, fresh, repeat(-1)), np.int64, len(fresh))
        moved, new = np.flatnonzero(was >= 0), np.flatnonzero(was < 0)
        if len(new):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([fresh[i] for i in new] if len(moved) else fresh, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            store.put(base + new, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)
        if len(moved):
            store.put(base + moved, *self.old_store.gather(was[moved]))
        self.index.fresh = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of ``texts`` one after another, and how many each text has; null is empty."""
        if len(self.index) > self.cached:
            self.old_index, self.old_store = self.index, self.store
            self.index, self.store = _Index(), _Store()
        index, pattern, known, counts = self.index, self.pattern, [], []
        for text in texts:
            text = text or ""
            chunks = [text] if _ODD.search(text) else pattern.findall(text)
            known.append(np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks)))
            counts.append(len(chunks))
        self._learn()
        ids, sizes = self.store.gather(np.concatenate(known) if known else np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, np.diff(ends)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, keep_space: bool = True) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = ChunkEncoder(path, keep_space)
    return _ENCODERS[path, keep_space]

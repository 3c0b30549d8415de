"""Fingerprints, vectors and hashed embeddings.

Bit and array arithmetic is native; hashing of features, which needs unsigned overflow, runs in vectorised Python kernels on token arrays that the JVM has made.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.functions import pandas_udf

from ..types import data_type
from .text import tokenize

# Fixed values of the fingerprint and embedding formats.
FNV64_OFFSET, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
FNV32_PRIME, MIX_A, MIX_B = 0x01000193, 0x85EBCA6B, 0xC2B2AE35
BUCKET_SEED, SIGN_SEED = 0x9E3779B9, 0x85EBCA6B
SIMHASH_BITS, BANDS, BAND_HEX, DUPLICATE_DISTANCE, DIMENSIONS = 64, 4, 4, 3, 384
PAIR_MARK = "\x01"
_RUN = 200_000


def _units(strings: list[str], mask: int = 0xFFFF) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 code units of strings in one padded matrix, and their lengths."""
    raw = [np.frombuffer(s.encode("utf-16-le", "surrogatepass"), "<u2") for s in strings]
    sizes = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), int(sizes.max(initial=0))), np.uint64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.concatenate([np.zeros(0, "<u2"), *raw])
    return out & np.uint64(mask), sizes


def _fed(h: np.ndarray, units: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """FNV states ``h`` after the strings of ``rows``."""
    for j in range(int(sizes[rows].max(initial=0))):
        live = np.flatnonzero(sizes[rows] > j)
        h[live] = (h[live] ^ units[rows[live], j]) * np.uint64(FNV64_PRIME)
    return h


def fnv64(strings: list[str], mask: int = 0xFFFF) -> np.ndarray:
    units, sizes = _units(strings, mask)
    return _fed(np.full(len(strings), FNV64_OFFSET, np.uint64), units, sizes, np.arange(len(strings)))


def hash32(strings: list[str], seed: int) -> np.ndarray:
    units, sizes = _units(strings)
    low = np.uint64(0xFFFFFFFF)
    h = np.full(len(strings), seed, np.uint64)
    for j in range(units.shape[1]):
        live = sizes > j
        h[live] = (h[live] ^ units[live, j]) * np.uint64(FNV32_PRIME) & low
    for shift, factor in ((16, MIX_A), (13, MIX_B)):
        h ^= h >> np.uint64(shift)
        h = h * np.uint64(factor) & low
    return h ^ h >> np.uint64(16)


def simhashes(tokens: pa.ListArray) -> np.ndarray:
    """A 64-bit fingerprint a list: each bit is the sign of the weights of the features that have it; words weigh 1, neighbouring pairs 2. An empty list has 0.

    Every distinct word is hashed once, and a pair goes on from its first word's state.
    """
    counts = tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    encoded = tokens.flatten().dictionary_encode()
    ids = encoded.indices.to_numpy().astype(np.int64)
    units, sizes = _units(encoded.dictionary.to_pylist())
    words = _fed(np.full(len(sizes), FNV64_OFFSET, np.uint64), units, sizes, np.arange(len(sizes)))
    ends = np.cumsum(counts)
    out = np.zeros(len(counts), np.uint64)
    a = 0
    while a < len(counts):  # runs of rows, bounded by their words
        b = min(max(a + 1, int(np.searchsorted(ends, (ends[a] - counts[a]) + _RUN, side="right"))), len(counts))
        first, last = int(ends[a] - counts[a]), int(ends[b - 1])
        own, row = ids[first:last], np.repeat(np.arange(b - a), counts[a:b])
        pair = np.flatnonzero(row[1:] == row[:-1])
        pairs = _fed((words[own[pair]] ^ np.uint64(ord(PAIR_MARK))) * np.uint64(FNV64_PRIME), units, sizes, own[pair + 1])
        total = np.zeros((b - a, 64), np.int64)
        for hashed, of, weight in ((words[own], row, 1), (pairs, row[pair], 2)):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
            if len(starts):
                bits = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                n = np.diff(np.append(starts, len(of)))
                total[of[starts]] += weight * (2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) - n[:, None])
        out[a:b] = np.packbits(total > 0, axis=1, bitorder="little").view("<u8").ravel()
        a = b
    return out


@arrow_udf(data_type("string"))
def _simhash(tokens: pa.Array) -> pa.Array:
    return pa.array([f"{int(x):016x}" for x in simhashes(tokens)], pa.string())


def simhash(text: Column) -> Column:
    return _simhash(tokenize(text))


@pandas_udf(data_type("string"))
def fnv1a64(texts: pd.Series) -> pd.Series:
    """Sixteen hexadecimal digits of the 64-bit FNV-1a hash over the low bytes."""
    return pd.Series([f"{int(x):016x}" for x in fnv64([t or "" for t in texts], 0xFF)], dtype="object")


def simhash_bits(hex_: Column) -> Column:
    """The fingerprint as a signed long."""
    return F.shiftleft(F.conv(F.substring(hex_, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(hex_, 9, 8), 16, 10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints; 64 if one is malformed."""
    fine = lambda x: F.coalesce(x.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))
    return F.when(a == b, 0).when(fine(a) & fine(b), F.bit_count(simhash_bits(a).bitwiseXOR(simhash_bits(b)))).otherwise(64)


def is_near_duplicate(a: Column, b: Column, distance: int = DUPLICATE_DISTANCE) -> Column:
    return hamming(a, b) <= distance


def simhash_bands(hex_: Column) -> Column:
    """Four keys of sixteen bits: fingerprints at most three bits apart share one."""
    keys = F.array(*(F.concat(F.lit(f"{i}:"), F.substring(hex_, i * BAND_HEX + 1, BAND_HEX)) for i in range(BANDS)))
    return F.when(F.length(hex_) == 16, keys).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or without direction."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v.cast("array<float>"))


def embed_tokens(tokens: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed feature hashing: words with sublinear frequency, the three-character grams of long Latin words, neighbouring pairs."""
    out = np.zeros(dimensions, np.float32)
    if not len(tokens):
        return out
    names: list[str] = []
    weights: list[float] = []
    for token, n in Counter(tokens).items():
        tf = 1 + np.log(n)
        names.append(token)
        weights.append(tf)
        if len(token) > 3 and token[0].isascii() and token[0].isalnum():
            padded = f"<{token}>"
            grams = [padded[i : i + 3] for i in range(len(padded) - 2)]
            names += grams
            weights += [tf * 0.45 / len(grams)] * len(grams)
    names += [f"{a}_{b}" for a, b in zip(tokens[:-1], tokens[1:], strict=True)]
    weights += [0.35] * (len(tokens) - 1)
    sign = np.where(hash32(names, SIGN_SEED) & np.uint64(1), 1.0, -1.0)
    np.add.at(out, (hash32(names, BUCKET_SEED) % np.uint64(dimensions)).astype(np.int64), (sign * np.array(weights)).astype(np.float32))
    norm = float(np.sqrt((out.astype(np.float64) ** 2).sum()))
    return (out / norm).astype(np.float32) if norm else out


@pandas_udf(data_type("array<float>"))
def _embed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: embed_tokens([] if t is None else list(t)))


def hash_embed(text: Column) -> Column:
    return _embed(tokenize(text))


def item_text(title: Column, summary: Column, content: Column, topics: Column | None = None, author: Column | None = None) -> Column:
    """What is embedded of an item: the title three times, topics, summary, the start of the content, the author."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    topics = F.nullif(F.array_join(topics, " "), F.lit("")) if topics is not None else F.lit(None).cast("string")
    author = blank(author) if author is not None else F.lit(None).cast("string")
    return F.concat_ws("\n", blank(title), blank(title), blank(title), topics, blank(summary), F.substring(content, 1, 6000), author)


def interest_clusters(vectors: np.ndarray, k: int = 3, rounds: int = 8) -> np.ndarray:
    """Centres of a few bounded vectors: farthest-point seeds, then cosine Lloyd steps until none moves. Deterministic, on the driver."""
    v = np.asarray(vectors, np.float64)
    if not len(v):
        return v
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    v = unit(v)
    k = min(k, len(v))
    seeds = [0]
    while len(seeds) < k:
        seeds.append(int((v @ v[seeds].T).max(axis=1).argmin()))
    centres = v[seeds]
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(axis=1)
        moved = np.stack([unit(v[nearest == i].mean(axis=0)) if (nearest == i).any() else centres[i] for i in range(k)])
        still = (moved * centres).sum(axis=1).min() >= 0.9999
        centres = moved
        if still:
            break
    return centres


#: Embedders by name: a Column of text to a Column of vectors, and the least cosine of an echo. Others can be added; what is unknown falls back to hashing.
EMBEDDERS = {"hash": (hash_embed, 0.50)}


def embedder(name: str):
    return EMBEDDERS.get(name, EMBEDDERS["hash"])

"""Importance resampling towards a target: documents are drawn by how much more likely their n-grams are in the target than in the corpus.

n-grams are hashed into buckets; the gain of a bucket is the scaled log ratio of its smoothed rates in target and corpus, the weight of a document the sum of the gains of its n-grams. With Gumbel noise
hashed from the key, the highest scores are a sample without replacement in proportion to the weights' exponentials.

Skewed long texts: a text of over ``chunk_bytes`` is cut at word boundaries into chunks, each with the n - 1 words that follow as carry. A chunk owns the n-grams that start in its own words, so counts and weights of
chunks add up to those of the text, whatever the cut. Chunks are dealt out to all tasks, their counts combined before they are shuffled, and summed by document.

Nulls: a null text has no words, a null key hashes as the empty string and is last among ties. Repeated rows and keys are documents of their own. Other columns, whatever their names, are left out. An empty corpus gives
no rows; an empty target has counts of nought.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import column, partitions, small_batches, written
from ._words import LOWER, Words, per_document, slices, text_buffers

#: Bytes of words: digits, lower-case letters, and all of characters outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Longer words are hashed one by one.
_LONG = 32


def _crc_table() -> np.ndarray:
    """The remainders of all bytes for the reflected polynomial of CRC-32."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, rest >> 1 ^ np.uint32(0xEDB88320), rest >> 1)
    return rest


_CRC = _crc_table()


def crc_spans(before: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what has the CRC ``before``, followed by a span of bytes each."""
    sizes, rest = ends - starts, before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(sizes, _LONG + 1), kind="stable")
    live, of = rest[order], starts[order]
    reach = np.searchsorted(-np.minimum(sizes, _LONG + 1)[order], -np.arange(_LONG + 1), side="left")
    for j, k in enumerate(reach):  # the first k spans are longer than j
        if not k:
            break
        live[:k] = _CRC[(live[:k] ^ data[of[:k] + j]) & np.uint32(0xFF)] ^ (live[:k] >> np.uint32(8))
    rest[order] = live
    rest ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > _LONG):
        rest[i] = zlib.crc32(data[starts[i] : ends[i]], int(before[i]))
    return rest


def folded_words(texts: pa.Array) -> Words:
    """Words of lower-cased texts."""
    data, offsets = text_buffers(texts)
    data, offsets = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    inside = _WORD[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets), offsets)


def gram_buckets(w: Words, order: int, buckets: int, owned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to ``order`` words of a row. ``owned``: how many first words of a row n-grams may start at; all, if None."""
    n, row = len(w.starts), w.docs()
    free = np.arange(n) - w.firsts[row] < owned[row] if owned is not None else np.ones(n, bool)
    last = w.firsts[row + 1] if n else np.zeros(0, np.int64)
    crc = np.zeros(n, np.uint32)
    rows, found = [], []
    for size in range(1, order + 1):
        at = np.flatnonzero(np.arange(n) + size <= last)
        tail = at + size - 1
        state = crc[at]
        if size > 1:
            state = crc_spans(state, np.frombuffer(b" ", np.uint8), np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
        crc[at] = crc_spans(state, w.data, w.starts[tail], w.ends[tail])
        keep = at[free[at]]
        rows.append(row[keep])
        found.append(crc[keep] % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _chunked(docs: DataFrame, id_col: str, text_col: str, order: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Short texts (doc_id, text, owned null) and the chunks of long ones (doc_id, of, chunk, text, owned); ``of`` tells texts of one key apart."""
    small_batches(docs.sparkSession)
    named = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w = folded_words(b.column(2).slice(i, 1))
                n = len(w.starts)
                at, chunk = 0, 0
                while at < max(n, 1):
                    to = max(at + 1, int(np.searchsorted(w.ends, w.starts[at] + chunk_bytes, side="right"))) if n else 0
                    to = min(to, n)
                    stop = min(to + order - 1, n)
                    piece = w.data[w.starts[at] : w.ends[stop - 1]].tobytes().decode() if n else ""
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([chunk], pa.int64()), pa.array([piece]), pa.array([to - at], pa.int64())], ["doc_id", "of", "chunk", "text", "owned"])
                    at, chunk = max(to, 1), chunk + 1

    long = named.filter(size > chunk_bytes).select("doc_id", F.xxhash64("text").alias("of"), "text").mapInArrow(cut, "doc_id long, of long, chunk long, text string, owned long")
    return named.filter(size <= chunk_bytes), long.repartition(partitions(docs.sparkSession), "doc_id", "of", "chunk")


def bucket_counts(docs: DataFrame, text_col: str = "text", order: int = 1, buckets: int = 10_000, id_col: str = "doc_id", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket. A task adds up what it reads, so at most ``buckets`` rows of each are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            owned = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(b.column(0)):
                _, found = gram_buckets(folded_words(b.column(0).slice(i, j - i)), order, buckets, owned[i:j])
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    short, long = _chunked(docs, id_col, text_col, order, chunk_bytes)
    parts = [d.mapInArrow(count, "bucket long, n long") for d in (short.select("text", F.lit(2**62).alias("owned")), long.select("text", "owned"))]
    return parts[0].union(parts[1]).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket, in thousandths of a nat, rounded down. Both tables of counts have at most ``buckets`` rows, which bounds what the driver holds."""
    counts = []
    for table in (corpus, target):
        n = np.zeros(buckets, np.int64)
        for r in table.collect():
            n[r["bucket"]] = r["n"]
        counts.append(n.tolist())
    s, t = counts
    whole_s, whole_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (whole_s + buckets) / ((a + 1) * (whole_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def document_weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = 1, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight. ``gain`` has one number a bucket and goes to the workers with the function."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                owned = b.column("owned").slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                w = folded_words(b.column("text").slice(i, j - i))
                row, found = gram_buckets(w, order, buckets, owned)
                n = np.bincount(row, minlength=j - i)
                weight = np.bincount(row, gain[found], minlength=j - i).astype(np.int64)  # sums of whole numbers, exact in doubles
                keys = [b.column(c).slice(i, j - i) for c in b.schema.names if c not in ("text", "owned")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.minimum(w.counts, owned)), pa.array(n), pa.array(weight)], [*(c for c in b.schema.names if c not in ("text", "owned")), "n_words", "n_features", "weight"])

    sums = "n_words long, n_features long, weight long"
    short, long = _chunked(docs, id_col, text_col, order, chunk_bytes)
    whole = short.withColumn("owned", F.lit(2**62)).mapInArrow(weigh, f"doc_id long, {sums}")
    by_chunk = long.mapInArrow(weigh, f"doc_id long, of long, chunk long, {sums}")
    totals = by_chunk.groupBy("doc_id", "of").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")), F.count_if(F.col("chunk") == 0).alias("rows"))
    each = totals.select("doc_id", *(F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    return whole.union(each.drop("row"))


def with_scores(weighed: DataFrame, seed: str) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise in thousandths, rounded down, of the first 32 bits of the SHA-256 of ``seed:key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, seed: str = "2024", percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight, score, and rank from 1 if drawn, else null.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100) of the highest scores are drawn, ties to the smaller key (null last). Ranks are places in range partitions plus the rows of those
    before, so no task or driver holds more than a partition; the last range keys are hashes of the row, so that rows of one key are dealt out, too.
    """
    spark = docs.sparkSession
    spread = partitions(spark)
    probe = target.select(F.lit(0).cast("long").alias("doc_id"), column(target, target_text_col).alias("text"))
    gain = gains(bucket_counts(docs, text_col, order, buckets, id_col, chunk_bytes), bucket_counts(probe, "text", order, buckets, "doc_id", chunk_bytes), buckets)
    scored = written(with_scores(document_weights(docs, gain, id_col, text_col, order, chunk_bytes), seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.filter(fit).count() * percent // 100
    place = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    sorted_rows = scored.filter(fit).repartitionByRange(spread, *place).sortWithinPartitions(*place)
    placed = written(sorted_rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "placed")
    sizes, before = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}, 0  # one row a partition
    starts = []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = spark.createDataFrame(starts, "part int, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    columns = ("doc_id", "n_words", "n_features", "weight", "score")
    ranked = placed.join(F.broadcast(offsets), "part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.union(scored.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))

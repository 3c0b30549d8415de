"""Language-model scores of documents by stupid backoff.

The score of a word after a context is c(context word) / c(context) for the longest context, of up to ``order`` - 1 words, with which the corpus has the word at least ``least_count`` times, times ``backoff`` for each
word of context given up; without context it is c(word) / N. A document's score is the sum of ln S over its words. All n-grams count, of any frequency, under 64-bit hashes; nothing is broadcast.

Documents under a given table (``backoff_scores``, of any order): ``ngram_counts`` is the count table; every place of a document gives its n-grams of all orders, which are joined to the counts, and takes the longest one seen.

The corpus under its own counts (``whole_scores``, bigrams, what the query takes): every bigram has been seen, so nothing is backed off, and a score is the sum of ln c(v w) over
bigrams, less that of ln c(v) over all words but the last, plus ln c(w) - ln N of the first. Exploded rows of a gram, a slice and its documents, joined to the count table by Spark, were tried and take over five times
the input on disk for one shuffle, so they go packed:

1. Each slice of documents makes its words and bigrams into sorted 64-bit hashes, each with the documents that have it and how often, packed by range of hashes: one row a slice and bucket. Buckets hold about
   ``BUCKET_BYTES`` of text each, so their number grows with the input.
2. A bucket has all occurrences of its words and bigrams. It counts them, then goes through its slices once more and sums the logarithms by document; only the packed rows and the distinct hashes are held, and a
   frequent bigram is about three bytes for each document.
3. These sums are added by slice, and N, the sum of all documents' words, comes in last.

Defined results: a document without words has 0 words and score 0, and a null mean. Rows that repeat a key are scored together, as one document of several texts, without n-grams across them.
Null keys are one document. Words are ASCII lower-cased. A word that a given table lacks counts as seen once. Extra columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import keyed_text, partitions, written
from ._graph import runs
from ._words import LOWER, Words, chained, hashes, mix, slices, within, words

BUCKET_BYTES = 8 << 20
_SLICE = 4 << 20
#: Kind 0: a slice's documents; 1: occurrences of a bucket's words in it (``ends``: how many begin or end a text); 2: of its bigrams.
_OCCURRENCES = "bucket int, slice string, kind int, size int, n int, keys binary, runs binary, docs binary, times binary, ends binary, doc_ids binary, missing binary, words binary"
_SUMS = "slice string, head int, n int, docs binary, gains binary, doc_ids binary, missing binary, words binary"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _folded(texts: pa.Array) -> tuple[Words, np.ndarray]:
    w = words(texts)
    return w, hashes(LOWER[w.data], w.starts, w.ends)


def _grams(w: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``k`` words, and their first words."""
    first = within(w, k)
    return mix(chained(h, k)[first] + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)), first


def _places(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word its document, its place there, and how many words follow."""
    docs = w.docs()
    place = np.arange(len(w.starts)) - w.firsts[docs]
    return docs, place, w.counts[docs] - 1 - place


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and texts (rows with a word) of every document of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [words(batch.column(1).slice(at, to - at)).counts for at, to in slices(batch.column(1))]
            n = np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array((n > 0).astype(np.int64))], ["doc_id", "n_words", "texts"])

    return docs.mapInArrow(run, "doc_id long, n_words long, texts long").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("texts").alias("texts"))


def ngram_counts(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gram, count of all n-grams of up to ``order`` words; gram 0 has the number of all words."""
    own = keyed_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1), _SLICE):
                w, h = _folded(batch.column(1).slice(at, to - at))
                grams, n = np.unique(np.concatenate([_grams(w, h, k)[0] for k in range(1, order + 1)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

    total = lengths(own).agg(F.lit(0).cast("long").alias("gram"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("count"))
    return own.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("count")).union(total)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte place, without the places that are zero in all."""
    width = max((int(x.max()).bit_length() + 7) // 8, 1)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[k]) for j, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _least(bucket: int, buckets: int) -> int:
    """A bound below the hashes of a bucket."""
    return ((bucket << 32) // buckets) << 32


def occurrences(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed occurrences of all words and bigrams by bucket, and each slice's documents."""

    def rows(kind: int, name: str, keys: np.ndarray, owner: np.ndarray, ends: np.ndarray | None) -> Iterator[tuple]:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")  # owners ascend, so they stay sorted within a key
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
        times = np.diff(np.append(first, len(keys)))
        ends = np.add.reduceat(ends[order], first) if ends is not None else None
        keys, owner = keys[first], owner[first]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        met, held = keys[starts], np.diff(np.append(starts, len(keys)))
        bucket = ((met >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        starts = np.append(starts, len(keys))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at, to = starts[a], starts[b]
            gaps = np.diff(met[a:b], prepend=np.uint64(_least(int(bucket[a]), buckets)))
            yield int(bucket[a]), name, kind, int(b - a), int(to - at), _planes(gaps), _planes(held[a:b]), _planes(owner[at:to]), _planes(times[at:to]), None if ends is None else _planes(ends[at:to]), None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, to in slices(batch.column(1), _SLICE):
                w, h = _folded(batch.column(1).slice(at, to - at))
                name, made = f"{task}-{made}", made + 1  # the same when a task is run again
                owner, some = w.docs(), w.counts > 0
                first, last = np.zeros(len(h), bool), np.zeros(len(h), bool)
                first[w.firsts[:-1][some]] = True
                last[w.firsts[1:][some] - 1] = True
                ids = batch.column(0).slice(at, to - at)
                head = (ids.fill_null(0).to_numpy().astype("<i8"), np.asarray(ids.is_null()).astype(np.uint8), w.counts.astype("<i8"))
                out = [((task * 7919 + made) % buckets, name, 0, 0, 0, None, None, None, None, None, *(x.tobytes() for x in head))]
                out += rows(1, name, h, owner, first.astype(np.int64) + last)
                pair = np.flatnonzero(~first[1:])
                out += rows(2, name, chained(h, 2)[pair], owner[pair], None)
                yield _batch(out, _OCCURRENCES)

    return docs.mapInArrow(run, _OCCURRENCES)


def whole_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, of every document, from the counts of all words and all bigrams."""
    spark = docs.sparkSession
    own = keyed_text(docs, id_col, text_col)
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))

    def gained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            base = np.uint64(_least(table.column("bucket")[0].as_py(), buckets))
            kinds, sizes, counted = (table.column(n).to_numpy() for n in ("kind", "size", "n"))
            get = lambda name, i: table.column(name)[int(i)].as_py()  # noqa: B023, E731
            keys_of = lambda i: np.cumsum(_numbers(get("keys", i), sizes[i]), dtype=np.uint64) + base  # noqa: B023, E731
            known = {}
            for kind in (1, 2):
                keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for i in np.flatnonzero(kinds == kind):
                    starts = np.cumsum(_numbers(get("runs", i), sizes[i]).astype(np.int64))
                    keys.append(keys_of(i))
                    counts.append(np.add.reduceat(_numbers(get("times", i), counted[i]).astype(np.int64), np.append(0, starts[:-1])))
                keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
                known[kind] = keys, np.log(counts)
            out: list[tuple] = []
            names, i = table.column("slice").to_pylist(), 0
            while i < len(names):
                to = i + 1
                while to < len(names) and names[to] == names[i]:
                    to += 1
                owners, gains = [], []
                for j in range(i, to):
                    if kinds[j] == 0:
                        out.append((names[j], 0, 0, None, None, *(get(n, j) for n in ("doc_ids", "missing", "words"))))
                        continue
                    keys, logs = known[kinds[j]]
                    weight = _numbers(get("times", j), counted[j]).astype(np.int64)
                    if kinds[j] == 1:
                        weight = _numbers(get("ends", j), counted[j]).astype(np.int64) - weight
                    owners.append(_numbers(get("docs", j), counted[j]))
                    gains.append(np.repeat(logs[np.searchsorted(keys, keys_of(j))], _numbers(get("runs", j), sizes[j]).astype(np.int64)) * weight)
                if owners:
                    owner, place = np.unique(np.concatenate(owners), return_inverse=True)
                    out.append((names[i], 1, len(owner), _planes(owner), np.bincount(place, weights=np.concatenate(gains)).tobytes(), None, None, None))
                i = to
                if len(out) > 500:
                    yield _batch(out, _SUMS)
                    out = []
            if out:
                yield _batch(out, _SUMS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = words_of = total = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(words_of), pa.array((words_of > 0).astype(np.int64)), pa.array(total)], ["doc_id", "n_words", "texts", "gain"])

        for b in batches:
            for head, n, docs_of, gains, doc_ids, missing, counted in zip(*(b.column(j).to_pylist() for j in range(1, 8)), strict=True):
                if head == 0:
                    if ids is not None:
                        yield out()
                    ids = pa.array(np.frombuffer(doc_ids, "<i8"), mask=np.frombuffer(missing, np.uint8).astype(bool))
                    words_of = np.frombuffer(counted, "<i8")
                    total = np.zeros(len(words_of))
                else:
                    total[_numbers(docs_of, n).astype(np.int64)] += np.frombuffer(gains, np.float64)
        if ids is not None:
            yield out()

    packed = occurrences(own, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice")
    gains = packed.mapInArrow(gained, _SUMS).repartition(partitions(spark), "slice").sortWithinPartitions("slice", "head")
    parts = written(gains.mapInArrow(summed, "doc_id long, n_words long, texts long, gain double"), "scores")
    every = parts.agg(F.sum("n_words")).first()[0] or 0
    sums = parts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), (F.sum("gain") - F.sum("texts") * float(np.log(max(every, 1)))).alias("log_score"))
    return _means(sums)


def _means(scored: DataFrame) -> DataFrame:
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def backoff_scores(docs: DataFrame, counts: DataFrame, order: int = 2, least_count: int = 1, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, of every document, under ``counts`` (gram, count) as ``ngram_counts`` gives them."""
    own = keyed_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy()
            for at, to in slices(batch.column(1)):
                w, h = _folded(batch.column(1).slice(at, to - at))
                docs_of, place, _ = _places(w)
                below = None
                for k in range(1, order + 1):
                    gram, first = _grams(w, h, k)
                    last = first + k - 1
                    context = np.zeros(len(first), np.uint64) if below is None else below[first]
                    below = np.zeros(len(h), np.uint64)
                    below[first] = gram
                    given_up = np.minimum(order, place[last] + 1) - k
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at).take(pa.array(docs_of[last])), pa.array(keys[at:to][docs_of[last]]), pa.array(place[last]), pa.array(np.full(len(first), k)), pa.array(given_up), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["doc_id", "row", "place", "k", "given_up", "gram", "context"])

    written_rows = written(own.select("doc_id", "text", "row"), "rows")  # so that row numbers stay
    places = written_rows.mapInArrow(run, "doc_id long, row long, place long, k long, given_up long, gram long, context long")
    found = places.join(counts.select("gram", F.col("count").alias("c")), "gram", "left").join(counts.select(F.col("gram").alias("context"), F.col("count").alias("below")), "context", "left")
    seen = (F.coalesce("c", F.lit(0)) >= least_count) | (F.col("k") == 1)
    score = F.log(F.greatest(F.coalesce("c", F.lit(1)), F.lit(1)) / F.greatest(F.coalesce("below", F.lit(1)), F.lit(1))) + F.col("given_up") * float(np.log(backoff))
    best = found.filter(seen).groupBy("doc_id", "row", "place").agg(F.max_by(score, "k").alias("score"))
    sums = best.groupBy(F.col("doc_id").alias("of")).agg(F.sum("score").alias("score"))
    scored = lengths(written_rows.select("doc_id", "text")).join(sums, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return _means(scored.select("doc_id", "n_words", F.coalesce("score", F.lit(0.0)).alias("log_score")))

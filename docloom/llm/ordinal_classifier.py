"""Quality grades by ordinal regression: one set of weights over hashed text, ordered thresholds between grades.

P(grade >= k) = sigmoid(weights . features - threshold_k), with thresholds in ascending order. Features are whether a document has a word (ASCII letters lower-cased, one
closing mark dropped, hashed to ``BINS``) and a few shares of its shape (repeats of the word before, symbols, upper case) in tenths. Fitted by
AdaGrad on at most ``sample_rows`` labelled documents, those least by a hash of their key: the one bound, and the only part that does not see all rows.

Defined results: a document without words (null or empty text) has grade 0 expected, tail probability 0, and is not kept where a model was fitted. Without labelled documents, or with
one grade only, nothing is known: expected_grade and tail_probability are null and every document is kept. Of several labels of a document the worst counts, labels that are null
count as bad, and labels of unknown documents are ignored. Repeated rows are scored row by row; extra columns are passed over by the scores and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import column, keyed_text, small_batches
from ._words import LOWER, hashes, per_document, slices, words

BINS = 1 << 18
SHAPES = 3
WIDTH = BINS + 11 * SHAPES
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,;:?"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after another, how many each has, and how many words."""
    w = words(texts)
    n = w.counts
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(len(n), np.int64), n
    ends = w.ends - (_CLOSING[w.data[w.ends - 1]] & (w.ends - w.starts > 1))
    h = hashes(LOWER[w.data], w.starts, ends)
    docs = w.docs()
    key = np.unique(docs * WIDTH + (h & np.uint64(BINS - 1)).astype(np.int64))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
    filled = np.flatnonzero(n)
    size = np.maximum(np.diff(w.offsets), 1)
    shares = (per_document(again, w.firsts) / np.maximum(n, 1), np.minimum(1, 4 * per_document(_SYMBOL[w.data], w.offsets) / size), per_document(_UPPER[w.data], w.offsets) / size)
    shape = [filled * WIDTH + BINS + 11 * i + np.floor(10 * s[filled]).astype(np.int64) for i, s in enumerate(shares)]
    key = np.sort(np.concatenate([key, *shape]))
    return key % WIDTH, np.bincount(key // WIDTH, minlength=len(n)), n


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, total: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - total[:, None], -50, 50)))

    def totals(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(self.weights[numbers], dtype=np.float64)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return ends[at[1:]] - ends[at[:-1]]


def fit(numbers: np.ndarray, counts: np.ndarray, grades: np.ndarray, epochs: int = 25, rate: float = 0.2, shrink: float = 2e-4, least_documents: int = 3, least_score: float = 4.0, batch: int = 64, seed: int = 11) -> Model | None:
    """The model of documents' features and grades 0, 1, ...; None with fewer than two grades.

    Only telling features get a weight: those of at least ``least_documents`` documents whose mean grade is ``least_score`` standard errors from that of all.
    """
    if len(np.unique(grades)) < 2:
        return None
    top = int(grades.max())
    held = np.bincount(numbers, minlength=WIDTH)
    mean = np.bincount(numbers, weights=np.repeat(grades, counts), minlength=WIDTH) / np.maximum(held, 1)
    often = (held >= least_documents) & (np.abs(mean - grades.mean()) * np.sqrt(held) >= least_score * grades.std())
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(counts)), counts)
    keep = often[numbers]
    column_of, row = place[numbers[keep]], row[keep]
    starts = np.searchsorted(row, np.arange(len(counts) + 1))
    w, seen = np.zeros(int(often.sum()) + 1), np.full(int(often.sum()) + 1, 1e-8)
    share = np.array([np.clip((grades < k).mean(), 0.01, 0.99) for k in range(1, top + 1)])
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 0.01 * np.arange(top))
    seen_theta, rng = np.full(top, 1e-8), np.random.default_rng(seed)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            sizes = starts[rows + 1] - starts[rows]
            at = np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            own, of = column_of[at], np.repeat(np.arange(len(rows)), sizes)
            total = np.bincount(of, weights=w[own], minlength=len(rows))
            y = grades[rows]
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            upper, lower = sigmoid(edges[y + 1] - total), sigmoid(edges[y] - total)
            upper[y == top], lower[y == 0] = 1, 0
            pull = 1 - upper - lower  # of the loss, by the total
            used, inverse = np.unique(own, return_inverse=True)
            g = np.bincount(inverse, weights=pull[of], minlength=len(used)) / len(rows) + shrink * w[used]
            seen[used] += g * g
            w[used] -= rate * g / np.sqrt(seen[used])
            chance = np.maximum(upper - lower, 1e-6)
            g = np.zeros(top + 2)
            np.add.at(g, y + 1, -upper * (1 - upper) / chance)
            np.add.at(g, y, lower * (1 - lower) / chance)
            g = g[1:-1] / len(rows)
            seen_theta += g * g
            theta = np.maximum.accumulate(theta - rate * g / np.sqrt(seen_theta))
    weights = np.zeros(WIDTH, np.float32)
    weights[often] = w[:-1]
    return Model(weights, theta)


def graded(labels: DataFrame) -> Column:
    """Grades of the labels table: 0 bad, 1 good but toxic, 2 good."""
    quality, toxic = F.coalesce(labels["quality"], F.lit(0)), F.coalesce(labels["toxic"], F.lit(1))
    return F.when(quality <= 0, 0).when(toxic > 0, 1).otherwise(2)


def fit_on(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> Model | None:
    """The model fitted on at most ``sample_rows`` labelled documents of ``docs``; ``grade``: a column over ``labels``, which has ``id_col``. Of rows that repeat a key, the text of least hash counts."""
    known = labels.select(column(labels, id_col).cast("long").alias("doc_id"), grade.cast("int").alias("grade")).filter("doc_id is not null and grade is not null")
    known = known.join(docs.select(column(docs, id_col).cast("long").alias("doc_id")), "doc_id", "left_semi")
    sample = known.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = keyed_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade", F.xxhash64("text").alias("mark"))  # sample_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in slices(b.column(1)):
                numbers, counts, _ = features(b.column(1).slice(at, to - at))
                ends = np.cumsum(counts)
                held = pa.array([numbers[e - n : e].astype(np.int32).tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(2).slice(at, to - at), b.column(3).slice(at, to - at), held], ["doc_id", "grade", "mark", "numbers"])

    one = rows.mapInArrow(run, "doc_id long, grade int, mark long, numbers binary").groupBy("doc_id").agg(F.min(F.struct("mark", "grade", "numbers")).alias("one"))
    found = one.select("doc_id", "one.grade", "one.numbers").collect()
    found.sort(key=lambda r: r["doc_id"])
    parts = [np.frombuffer(r["numbers"], np.int32) for r in found]
    return fit(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64), np.array([len(p) for p in parts], np.int64), np.array([r["grade"] for r in found], np.int64))


def _scored(model: Model | None, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    if model is None:
        return pa.nulls(len(texts), pa.float64()), pa.nulls(len(texts), pa.float64()), np.ones(len(texts), bool)
    expected, last = [np.zeros(0)], [np.zeros(0)]
    for at, to in slices(texts):
        numbers, counts, n = features(texts.slice(at, to - at))
        tails = np.where(n[:, None] > 0, model.tails(model.totals(numbers, counts)), 0)
        expected.append(tails.sum(axis=1))
        last.append(tails[:, -1])
    tail = np.concatenate(last)
    return pa.array(np.concatenate(expected)), pa.array(tail), tail


def grade_documents(docs: DataFrame, model: Model | None, bound: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the best grade), kept (at least ``bound``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            expected, tail, chance = _scored(model, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), expected, tail, pa.array(chance >= bound)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def keep_graded(docs: DataFrame, model: Model | None, bound: float = 0.6, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose probability of the best grade is at least ``bound``."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scored(model, b.column(at))[2] >= bound))

    return docs.mapInArrow(run, docs.schema)

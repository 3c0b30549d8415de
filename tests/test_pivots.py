"""Nearest vectors through pivots and by one pass against all pairs in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators.pivots import nearest_by_pivots
from docloom.operators.ranking import nearest_vectors


def clustered(n, dim=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dim))
    return middles[rng.integers(groups, size=n)] + 0.08 * rng.normal(size=(n, dim))


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)], "id long, embedding array<double>")


def slow(corpus, queries, k, floor=-1.0, skip=True):
    """All pairs; cosines in steps of 1e-9, so that rounding makes no order among ties."""
    out = {}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-30)
    for q, v in queries:
        near = sorted((-round(float(unit(v) @ unit(c)), 9), i) for i, c in corpus if not (skip and i == q))
        out[q] = [(i, -s) for s, i in near if -s >= floor][:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], round(r["similarity"], 9))
    return {q: [rows[i] for i in range(1, len(rows) + 1)] for q, rows in out.items()}


def agree(got, want):
    assert got.keys() == {q for q, rows in want.items() if rows}
    for q, rows in want.items():
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in rows], abs=2e-9)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in rows]


@pytest.mark.parametrize(("k", "parts", "turns"), [(1, 4096, 16_384), (3, 17, 9)])
def test_all_neighbours(spark, k, parts, turns):
    vectors = clustered(700)
    rows, costs = list(enumerate(vectors)), []
    df = frame(spark, vectors)
    agree(found(nearest_by_pivots(df, df, k, part_rows=parts, task_queries=turns, costs=costs)), slow(rows, rows, k))
    assert costs[0] < 700 * 700 / 5


def test_other_queries_floors_and_copies(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([clustered(150), np.tile(rng.normal(size=16), (80, 1)), np.zeros((3, 16)), clustered(1)])
    ids = rng.permutation(1000)[: len(vectors)]
    corpus, df = list(zip(ids.tolist(), vectors, strict=True)), frame(spark, vectors, ids)
    for k, floor in ((5, -1.0), (4, 0.5)):
        agree(found(nearest_by_pivots(df, df, k, floor, part_rows=50, task_queries=40)), slow(corpus, corpus, k, floor))
    asked = rng.normal(size=(40, 16))
    questions = list(zip(range(5000, 5040), asked, strict=True))
    for ask in (nearest_by_pivots, nearest_vectors):
        agree(found(ask(df, frame(spark, asked, range(5000, 5040)), 6)), slow(corpus, questions, 6))
    agree(found(nearest_vectors(df, df, 5)), slow(corpus, corpus, 5))
    agree(found(nearest_vectors(df, df, 3, block_rows=10)), slow(corpus, corpus, 3))


def test_bad_vectors_and_empty_tables(spark):
    bad = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0])], "id long, embedding array<double>").withColumn("key", F.lit("clash"))
    for ask in (nearest_by_pivots, nearest_vectors):
        assert found(ask(bad, bad, 1)) == {5: [(6, 1.0)], 6: [(5, 1.0)], 7: [(5, 0.0)]}
        assert ask(bad.limit(0), bad, 2).count() == ask(bad, bad.limit(0), 2).count() == 0
    one = bad.filter("id = 7")
    assert nearest_by_pivots(one, one, 2).count() == 0 and nearest_by_pivots(one, one, 2, skip_self=False).count() == 1


def test_an_index_that_changes(spark):
    """Set, delete, set again, against a dictionary; earlier states stay readable."""
    from docloom.operators.vectors import VectorIndex

    vectors = clustered(60, dim=6)
    kept = {i: tuple(map(float, v)) for i, v in enumerate(vectors[:40])}
    index = VectorIndex(6).put(frame(spark, vectors[:40]))
    state = lambda i: {r["id"]: tuple(r["embedding"]) for r in i.living(spark).collect()}
    first = index
    index = index.put(frame(spark, vectors[40:50], range(5, 15))).without(spark.createDataFrame([(5,), (6,), (39,), (39,), (999,)], "id long"))
    now = kept | {5 + i: tuple(map(float, v)) for i, v in enumerate(vectors[40:50])}
    now = {i: v for i, v in now.items() if i not in (5, 6, 39)}
    assert state(index) == now
    index = index.put(frame(spark, vectors[50:52], [6, 100]))
    now |= {6: tuple(map(float, vectors[50])), 100: tuple(map(float, vectors[51]))}
    assert state(index) == now == state(VectorIndex.opened(index.manifest())) and state(first) == kept
    small = index.compacted(spark)
    assert state(small) == now and len(small.segments) == 1 and not small.deletions
    bad = spark.createDataFrame([(1, [1.0] * 5, None), (2, None, None), (3, [float("nan")] * 6, None), (None, [1.0] * 6, None), (4, [2.0] * 6, "x"), (7, [3.0] * 6, None), (7, [2.0] * 6, None)], "id long, embedding array<double>, duplicate_of string")
    assert state(small.put(bad, "duplicate_of")) == now | {7: (3.0,) * 6}
    rows = [(i, np.array(v)) for i, v in now.items()]
    agree(found(small.nearest(small.living(spark), 2)), slow(rows, rows, 2))
    assert state(VectorIndex(6)) == {} and VectorIndex(6).without(spark.createDataFrame([(1,)], "id long")).living(spark).count() == 0

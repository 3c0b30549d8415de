"""The segmented index against BM25 by loops, through additions, updates, deletions and merges."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import segments
from docloom.operators.segments import SegmentedIndex

WORDS = ["alpha", "beta", "gamma", "delta", *(f"w{i}" for i in range(60))]
COLUMNS = {"title": 3.0, "body": 1.0}


def made(seed, names):
    rng = random.Random(seed)
    pick = lambda n: [rng.choice(WORDS[: rng.choice([4, 64])]) for _ in range(n)]
    return {name: (pick(rng.randint(0, 4)), pick(rng.choice([0, 3, 20, 200]))) for name in names}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, b) for i, (t, b) in docs.items()], "id string, title array<string>, body array<string>").withColumn("length", F.lit("clash"))


def slow(docs, terms, k, every):
    tf = {i: Counter({}) for i in docs}
    for i, (title, body) in docs.items():
        for t in title:
            tf[i][t] += 3.0
        for t in body:
            tf[i][t] += 1.0
    length = {i: len(t) + len(b) for i, (t, b) in docs.items()}
    mean, n = sum(length.values()) / len(docs), len(docs)
    out = []
    for i in docs:
        score, met = 0.0, 0
        for t in dict.fromkeys(terms):
            seen = sum(t in f for f in tf.values())
            idf = max(math.log((n - seen + 0.5) / (seen + 0.5)), 1e-6)
            if tf[i][t]:
                met += 1
                score += idf * tf[i][t] * 2.2 / (tf[i][t] + 1.2 * (0.25 + 0.75 * length[i] / mean))
        if met == len(set(terms)) or met and not every:
            out.append((-score, i))
    return [(i, pytest.approx(-s, abs=1e-9)) for s, i in sorted(out)[:k]]


def asked(spark, index, docs):
    for terms, k, every in ((["alpha", "w3"], 5, True), (["w1", "w2", "beta", "beta"], 7, False), (["gamma"], 3, True), (["nowhere", "alpha"], 4, False), (["nowhere"], 4, True)):
        got = [(r["id"], r["score"]) for r in index.search(spark, terms, k, every).collect()]
        assert got == slow(docs, terms, k, every), (terms, k, every)


def test_through_changes(spark, monkeypatch):
    monkeypatch.setattr(segments, "GROUP", 8)
    docs = made(1, [f"d{i}" for i in range(120)])
    index = SegmentedIndex().with_documents(frame(spark, docs), COLUMNS)
    asked(spark, index, docs)
    new = made(2, [f"d{i}" for i in range(100, 150)])
    first, index = index, index.with_documents(frame(spark, new), COLUMNS)
    index = index.without(spark.createDataFrame([(f"d{i}",) for i in (1, 2, 105, 105, 999)], "id string"))
    docs_now = {i: d for i, d in (docs | new).items() if i not in ("d1", "d2", "d105")}
    assert index.documents == len(docs_now)
    asked(spark, index, docs_now)
    back = made(3, ["d1", "d105"])  # what was deleted comes back
    index = index.with_documents(frame(spark, back), COLUMNS)
    asked(spark, index, docs_now | back)
    asked(spark, SegmentedIndex.opened(index.manifest()).merged(spark), docs_now | back)
    asked(spark, first, docs)  # a reader keeps what it has opened


def test_fewer_blocks_are_read(spark, monkeypatch):
    monkeypatch.setattr(segments, "GROUP", 16)
    rng = random.Random(4)
    docs = {f"d{i:04d}": ([], ["alpha"] * rng.choice([1, 1, 1, 9]) + [rng.choice(WORDS[4:]) for _ in range(rng.choice([4, 40, 400]))]) for i in range(600)}
    costs = {}
    index = SegmentedIndex().with_documents(frame(spark, docs), COLUMNS)
    got = [(r["id"], r["score"]) for r in index.search(spark, ["alpha", "w5"], 5, costs=costs).collect()]
    assert got == slow(docs, ["alpha", "w5"], 5, True)
    assert costs["read"] < costs["blocks"] / 2, costs


def test_empty(spark):
    none = frame(spark, {"x": ([], [])}).limit(0)
    index = SegmentedIndex().with_documents(none, COLUMNS)
    assert index.documents == 0 and index.search(spark, ["a"], 3).count() == 0 and SegmentedIndex().search(spark, [], 3).count() == 0
    one = index.with_documents(frame(spark, {"x": (None, ["a"]), "y": ([], [])}), COLUMNS)
    assert one.documents == 2 and [r["id"] for r in one.search(spark, ["a"], 3).collect()] == ["x"]
    assert one.without(one.living(spark).select("id")).merged(spark).search(spark, ["a"], 3).count() == 0

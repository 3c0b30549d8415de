"""Seek cursors and bitmap facets against plain loops."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from docloom.operators.bitmaps import bitmap_index
from docloom.operators.seek import clustered, decode_place, encode_place


def test_pages_by_seeking(spark):
    rng = random.Random(1)
    rows = [(f"i{i:04d}", rng.choice([None, 1.5, 2.0, 2.0, float(rng.randint(0, 50))])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id string, score double").withColumn("page", F.lit("clash"))
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    pages = clustered(frame, "score", ranges=25)
    got, cursor, sizes = [], None, []
    while True:
        page, cursor = pages.page(120, cursor)
        ids = [r["id"] for r in page.collect()]
        got += ids
        sizes.append(len(ids))
        if cursor is None:
            break
    assert got == want and sizes == [120, 120, 120, 120, 20]
    deep, _ = pages.page(10, encode_place(dict(rows)[want[430]], want[430]))
    assert [r["id"] for r in deep.collect()] == want[431:441]
    assert len(deep.inputFiles()) <= 4 < 20 <= len(pages.table.inputFiles())
    last, cursor = pages.page(10, encode_place(dict(rows)[want[-1]], want[-1]))
    assert last.count() == 0 and cursor is None
    assert decode_place("garbage!") is None and decode_place(None) is None and decode_place(encode_place(None, "x")) == (None, "x")
    empty, cursor = clustered(frame.limit(0), "score").page(5)
    assert empty.count() == 0 and cursor is None


def test_facets_under_filters(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choices(["x", "y", "z", None], k=rng.randint(0, 4)) if rng.random() < 0.9 else None) for i in range(700)]
    frame = spark.createDataFrame(rows, "id long, source string, tags array<string>").repartition(3)
    index = bitmap_index(frame, {"source": F.col("source"), "tag": F.col("tags")})
    for wanted in ([], [("tag", "x")], [("tag", "x"), ("tag", "y"), ("source", "a"), ("tag", "x")], [("tag", "nowhere")]):
        counts = Counter()
        for _, source, tags in rows:
            have = {("source", source)} | {("tag", t) for t in tags or []}
            if have.issuperset(wanted):
                counts.update(p for p in have if p[1] is not None)
        got = {(r["facet"], r["value"]): r["n"] for r in index.facets(wanted, {"source": 10, "tag": 2}).collect()}
        best = sorted(((d, v) for d, v in counts if d == "tag"), key=lambda p: (-counts[p], p[1]))[:2]
        assert got == {p: n for p, n in counts.items() if p[0] == "source" or p in best}
    plan = index.facets([("tag", "x")], {"source": 5})._jdf.queryExecution().executedPlan().toString()
    assert "tags" not in plan  # the index is read, not the items
    assert bitmap_index(frame.limit(0), {"source": F.col("source")}).facets([], {"source": 3}).count() == 0

"""Standing searches against one predicate after another."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from docloom.operators import library, standing
from docloom.operators.filters import matching
from docloom.schema import ITEM, KINDS, SOURCES, STATES


def items(spark, n=150, seed=2):
    rng = random.Random(seed)
    some = lambda values, most: rng.sample(values, rng.randint(0, most))
    rows = [
        (f"i{i}", rng.choice(SOURCES[:4]), rng.choice(KINDS[:4]), rng.choice(["en", "de", None]), rng.choice(["ann", "bob", None]), some(["a", "b", "c"], 2), some(["x", "y"], 2) if rng.random() < 0.9 else None, rng.choice([None, 10 * i]), 10 * i, float(rng.randint(0, 100)),
         rng.choice(STATES), rng.random() < 0.3 or None, rng.choice([None, 5]), "i0" if rng.random() < 0.1 else None)
        for i in range(n)
    ]
    f = spark.createDataFrame(rows, "id string, source string, kind string, lang string, handle string, tags array<string>, topics array<string>, published_ms long, captured_ms long, score double, state string, starred boolean, read_ms long, duplicate_of string")
    given = f.withColumn("author", F.struct(F.col("handle")))
    return given.select(*(F.col(n) if n in given.columns and n != "author" else F.struct(*(F.col("handle") if x.name == "handle" else F.lit(None).cast(x.dataType).alias(x.name) for x in ITEM["author"].dataType)).alias("author") if n == "author" else F.lit(None).cast(ITEM[n].dataType).alias(n) for n in ITEM.fieldNames()))


def searches(n=80, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        q = {"q": "words"}
        for name, values in (("sources", SOURCES[:4] + ("bogus",)), ("kinds", KINDS[:4]), ("authors", ("ann", "bob")), ("tags", ("a", "b", "c")), ("topics", ("x", "y")), ("states", STATES)):
            if rng.random() < 0.25:
                q[name] = rng.sample(list(values), rng.randint(0, 2))
        for name, values in (("lang", ["en", "de", ""]), ("min_score", [0, 50.5]), ("from_ms", [300]), ("to_ms", [900]), ("starred", [True, False]), ("unread", [True, False]), ("has_media", [True]), ("collection_id", ["c1", "c2"]), ("include_duplicates", [True])):
            if rng.random() < 0.2:
                q[name] = rng.choice(values)
        out.append({"id": f"s{i}", "query": json.dumps(q), "last_seen_ms": rng.choice([None, 0, 400])})
    return [*out, {"id": "bad", "query": "{not json", "last_seen_ms": None}, {"id": "none", "query": None, "last_seen_ms": 1000}, {"id": "same", "query": out[0]["query"], "last_seen_ms": out[0]["last_seen_ms"]}]


def test_counts_and_matches(spark):
    table, wanted = items(spark).cache(), searches()
    members = spark.createDataFrame([("c1", f"i{i}") for i in range(0, 150, 3)] + [("c1", "i0"), ("c2", "nowhere")], "collection_id string, item_id string")
    frame = spark.createDataFrame([(s["id"], s["query"], s["last_seen_ms"]) for s in wanted], "id string, query string, last_seen_ms long")
    got = {r["search_id"]: r["n"] for r in standing.standing_counts(table, frame, members).collect()}
    pairs = {(r["search_id"], r["id"]) for r in standing.standing_matches(table, frame, members).collect()}
    assert set(got) == {s["id"] for s in wanted}
    for s in wanted:
        query = library.stored_query(s["query"])
        ids = {r["id"] for r in matching(table, query, members).filter(F.col("captured_ms") > (s["last_seen_ms"] or 0)).collect()}
        assert got[s["id"]] == len(ids), s
        if any((query.sources, query.kinds, query.authors, query.tags, query.topics, query.lang, query.collection_id)):
            assert {i for x, i in pairs if x == s["id"]} == ids, s


def test_rarest_value_is_the_anchor(spark):
    table = items(spark, 60).withColumns({"source": F.lit("web"), "tags": F.when(F.col("id") == "i7", F.array(F.lit("rare"), F.lit("a"))).otherwise(F.array(F.lit("a")))})
    frame = spark.createDataFrame([("s", '{"sources": ["web"], "tags": ["a", "rare"]}', None), ("t", '{"sources": ["web", "x"]}', None), ("u", "{}", None)], "id string, query string, last_seen_ms long")
    keys = {(r["search_id"], r["key"]) for r in standing.anchored(table, standing.parsed(frame)).collect()}
    assert keys == {("s", "tags:rare"), ("t", "sources:web"), ("t", "sources:x")}
    assert standing.standing_counts(table, frame.limit(0)).count() == 0
    assert {r["n"] for r in standing.standing_counts(table.limit(0), frame).collect()} == {0}


def test_searches_alike_are_counted_once(spark, monkeypatch):
    """Three conditions of 900 searches that differ in when they were last seen: an item meets each condition once, whatever the number of searches."""
    table, kinds = items(spark).cache(), ['{"tags": ["a"]}', '{"min_score": 40}', '{"lang": "en", "starred": true}']
    frame = spark.createDataFrame([(f"s{i}", kinds[i % 3], i // 3 * 5 + i % 2) for i in range(900)], "id string, query string, last_seen_ms long")
    met, keep = [], standing._met
    monkeypatch.setattr(standing, "_met", lambda *a: (met.append(keep(*a)), met[-1])[1])
    got = {r["search_id"]: r["n"] for r in standing.standing_counts(table, frame).collect()}
    fits = [[r["captured_ms"] for r in matching(table, library.stored_query(k)).select("captured_ms").collect()] for k in kinds]
    assert got == {f"s{i}": sum(at > i // 3 * 5 + i % 2 for at in fits[i % 3]) for i in range(900)}
    assert len(met) == 1 and met[0].count() == len(fits[0]) + len(fits[2]) > 30

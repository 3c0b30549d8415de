"""Versioned tables: snapshots, copy-on-write, conflicts, crashes, transactions over several tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.types import struct

from docloom.operators.versions import Change, Conflict, Store, removal, upsert

SCHEMA = struct("k string, v long")


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.create("t", SCHEMA, "k", buckets=8)
    return made


def rows(spark, **kv):
    return spark.createDataFrame(list(kv.items()), SCHEMA)


def held(snapshot, name="t"):
    return {r["k"]: r["v"] for r in snapshot.table(name).collect()}


def test_snapshots_and_untouched_buckets(spark, store):
    assert held(store.snapshot()) == {} and store.snapshot(0).tables == {}
    first = store.transact({"t": Change(rows(spark, **{f"k{i}": i for i in range(100)}), upsert("k"))})
    second = store.transact({"t": Change(rows(spark, k1=-1, new=5), upsert("k"))})
    third = store.transact({"t": Change(rows(spark, k2=0, absent=0).select("k"), removal("k"))})
    want = {f"k{i}": i for i in range(100)}
    assert held(store.snapshot(first)) == want
    assert held(store.snapshot(second)) == want | {"k1": -1, "new": 5}
    assert held(store.snapshot()) == {k: v for k, v in (want | {"k1": -1, "new": 5}).items() if k != "k2"}
    before, after = store.snapshot(first).tables["t"]["paths"], store.snapshot(second).tables["t"]["paths"]
    touched = {str(b) for b in store.touched(rows(spark, k1=0, new=0), store.snapshot().tables["t"])}
    assert {b for b in after if before.get(b) != after[b]} == touched and len(touched) <= 2
    asked = store.snapshot().lookup("t", rows(spark, k1=0, k5=0, nowhere=0))
    assert {r["k"]: r["v"] for r in asked.collect()} == {"k1": -1, "k5": 5}
    assert len(asked.inputFiles()) < len(store.snapshot().table("t").inputFiles())
    with pytest.raises(ValueError, match="no version 99"):
        store.snapshot(99)


def test_two_writers(spark, store):
    """The second writer commits while the first has merged: neither change is lost, and the first merges anew only if a bucket of its own has changed."""
    merges = []

    def slow(other):
        def merge(old, new):
            if not merges:
                Store(spark, store.root).transact({"t": Change(other, upsert("k"))})
            merges.append(1)
            return upsert("k")(old, new)

        return merge

    store.transact({"t": Change(rows(spark, **{f"k{i}": i for i in range(50)}), upsert("k"))})
    meta = store.snapshot().tables["t"]
    bucket = {f"k{i}": store.touched(rows(spark, **{f"k{i}": 0}), meta)[0] for i in range(12)}
    apart = next(k for k in bucket if bucket[k] != bucket["k0"])
    store.transact({"t": Change(rows(spark, k0=100), slow(rows(spark, **{apart: 200})))})
    assert len(merges) == 1 and held(store.snapshot())["k0"] == 100 and held(store.snapshot())[apart] == 200
    merges.clear()
    store.transact({"t": Change(rows(spark, k0=300), slow(rows(spark, k0=250, k3=7)))})
    assert len(merges) == 2 and held(store.snapshot())["k0"] == 300 and held(store.snapshot())["k3"] == 7
    assert len(held(store.snapshot())) == 50


def test_crash_before_commit(spark, store, monkeypatch):
    store.transact({"t": Change(rows(spark, a=1), upsert("k"))})
    monkeypatch.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.transact({"t": Change(rows(spark, a=2, b=3), upsert("k"))})
    monkeypatch.undo()
    assert held(store.snapshot()) == {"a": 1}
    store.transact({"t": Change(rows(spark, c=4), upsert("k"))})
    assert held(store.snapshot()) == {"a": 1, "c": 4}
    assert store.vacuum() and held(store.snapshot()) == {"a": 1, "c": 4} and not store.vacuum()
    assert store.versions() == [store.snapshot().version]


def test_transactions(spark, store, monkeypatch):
    """Several tables change in one version or not at all."""
    store.create("log", struct("id long, what string"), "id", buckets=2)
    log = spark.createDataFrame([(1, "x")], "id long, what string")
    version = store.transact({"t": Change(rows(spark, a=1), upsert("k")), "log": Change(log, upsert("id"))})
    at = store.snapshot(version)
    assert held(at) == {"a": 1} and at.table("log").count() == 1 and store.snapshot(version - 1).table("log").count() == 0
    with pytest.raises(ValueError, match="a key is null"):
        store.transact({"t": Change(rows(spark, a=2), upsert("k")), "log": Change(spark.createDataFrame([(None, "y")], "id long, what string"), upsert("id"))})
    assert held(store.snapshot()) == {"a": 1}
    with pytest.raises(ValueError, match="don't touch"):
        store.transact({"t": Change(rows(spark, a=2), lambda old, new: new.unionByName(rows(spark, **{f"z{i}": i for i in range(40)})))})
    with pytest.raises(ValueError, match="already"):
        store.create("t", SCHEMA, "k")
    monkeypatch.setattr(store, "_commit", lambda *_: False)
    with pytest.raises(Conflict):
        store.transact({"t": Change(rows(spark, a=3), upsert("k"))}, tries=2)


def test_empty_changes_and_emptied_buckets(spark, store):
    store.transact({"t": Change(rows(spark, a=1).limit(0), upsert("k"))})
    store.transact({"t": Change(rows(spark, a=1), upsert("k"))})
    store.transact({"t": Change(rows(spark, a=1), removal("k"))})
    assert held(store.snapshot()) == {} and store.snapshot().tables["t"]["paths"] == {}


def test_ingestion_into_a_store(spark, tmp_path):
    """The same table as by full rewriting, with the buckets that a batch doesn't touch left alone."""
    from test_flows import HOUR, NOW, ROWS, batch

    from docloom.functions.scoring import Settings
    from docloom.plans import ingestion
    from docloom.schema import ITEM

    made = Store(spark, str(tmp_path / "items"))
    ingestion.run_into(made, batch(spark, ROWS), Settings(now_ms=NOW))
    before = made.snapshot()
    again = [ROWS[2] | {"tags": ["bread"]}, ROWS[1] | {"url": "https://e.example/5"}]
    outcome = ingestion.run_into(made, batch(spark, again), Settings(now_ms=NOW + HOUR))
    whole = ingestion.run(before.table("items"), batch(spark, again), Settings(now_ms=NOW + HOUR))
    columns = ["url_hash", "title", "state", "duplicate_of", "echo_count", F.round("score", 6), F.array_sort("tags")]
    rows_of = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows_of(made.snapshot().table("items")) == rows_of(whole.items) == rows_of(outcome.items)
    assert max(r["echo_count"] for r in made.snapshot().table("items").collect()) == 2
    paths, old = made.snapshot().tables["items"]["paths"], before.tables["items"]["paths"]
    assert any(paths.get(b) == p for b, p in old.items()) and made.snapshot().table("items").columns == ITEM.fieldNames()

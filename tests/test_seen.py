"""Sightings with bounded memory, against a loop; their state shrinks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.streaming import first_seen_within, keeping_state

HOUR = 3_600_000_000


def by_loop(rows, span):
    out, last, had = [], {}, {}
    for at, thin, number, url in sorted((r["at"], not r["full"], r["number"], r["url"]) for r in rows if r["url"] is not None and r["at"] is not None):
        if url not in last or at - last[url] >= span:
            out.append(number)
            had[url] = not thin
        elif not thin and not had[url]:
            out.append(number)
            had[url] = True
        last[url] = at
    return sorted(out)


def streamed(spark, folder, slices):
    schema = "number int, url string, full boolean, ts timestamp"
    for part in slices:
        made = spark.createDataFrame([(r["number"], r["url"], r["full"], r["at"]) for r in part], "number int, url string, full boolean, at long")
        made.withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = first_seen_within(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "5 hours", ties=("number",))
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    running = keeping_state(spark, writer.start)
    running.awaitTermination()
    found = sorted(r["number"] for r in spark.read.schema(rows.schema).parquet(f"{folder}/out").collect())
    return found, [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]


@pytest.fixture(scope="module")
def sightings():
    """Three slices of time: a hot URL, ties, repeats, nulls; the last has one URL only."""
    draw = random.Random(5)
    rows = []
    for part in range(3):
        for _ in range(150):
            url = "last" if part == 2 else draw.choice(["hot"] * 3 + [f"u{draw.randrange(20)}"] * 5 + [None])
            at = (1 + part * 40 + draw.randrange(38)) * HOUR  # a watermark begins at 1970
            rows.append({"url": url, "full": draw.choice([True, False, False, None]), "at": None if draw.random() < 0.03 else at})
    rows = [r | {"number": i} for i, r in enumerate(rows)]
    return [rows[i : i + 150] for i in range(0, 450, 150)]


def test_against_loop_and_state_shrinks(spark, tmp_path, sightings):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    found, kept = streamed(spark, tmp_path, sightings)
    assert found == by_loop([r for s in sightings for r in s], 5 * HOUR)
    assert max(kept) > 10 and kept[-1] <= 1  # the URLs of the first two slices are forgotten
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_empty(spark, tmp_path):
    assert streamed(spark, tmp_path, [[]])[0] == []

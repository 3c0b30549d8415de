"""Stored fingerprints: batches against a bucketed corpus."""

from __future__ import annotations

import random
import uuid

from docloom.operators.matching import KnownFingerprints


def fingerprints(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        v = rng.choice(out)[0] if out and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        out.append((v,))
    return [v for (v,) in out]


def slow(known, asked):
    out = {}
    for i, v in asked:
        near = sorted(((v ^ w).bit_count(), j) for j, w in known if j != i and v and w and (v ^ w).bit_count() <= 3)
        if near:
            out[i] = near[0]
    return out


def test_known_fingerprints(spark):
    values = fingerprints(4, 300) + [7, 7, 7, 0, 0]
    rows = list(enumerate(values))
    frame = lambda r: spark.createDataFrame([(i, f"{v:016x}") for i, v in r], "id long, simhash string")
    known = KnownFingerprints(spark, f"known_{uuid.uuid4().hex}", buckets=4)
    known.add(frame(rows[:200]))
    got = lambda r: {x["id"]: (x["distance"], x["match"]) for x in known.nearest(frame(r)).collect()}
    assert got(rows[150:]) == slow(rows[:200], rows[150:])
    known.add(frame(rows[200:]))
    assert got(rows) == slow(rows, rows)
    known.add(frame(rows[:50]))  # stored again
    assert got(rows) == slow(rows, rows)
    assert known.nearest(spark.createDataFrame([(1, None), (2, "xyz"), (3, "0" * 16)], "id long, simhash string")).count() == 0
    assert known.nearest(frame([])).count() == 0


def test_only_the_batch_is_shuffled(spark):
    known = KnownFingerprints(spark, f"known_{uuid.uuid4().hex}", buckets=8)
    batch = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(fingerprints(1, 400))], "id long, simhash string")
    known.add(batch)
    plan = known.candidates(batch)._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("SortMergeJoin") :].split("+- ")
    scan = next(i for i, line in enumerate(stored) if known.name in line and "FileScan" in line)
    above = [line for line in stored[scan - 4 : scan]]
    assert not any("Exchange hashpartitioning(choice" in line for line in above), plan
    assert plan.count("Exchange hashpartitioning(choice") == 1 and "Bucketed: true" in plan

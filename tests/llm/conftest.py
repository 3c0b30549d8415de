"""Messy inputs that every operator must take."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and to in a is that it for on was as with by an be this which or from at not are but had his they her she been has".split() + [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        line = [rng.choice(WORDS) for _ in range(rng.randint(5, 14))]
        out += [line[0].capitalize(), *line[1:-1], line[-1] + ".\n"]
    return " ".join(out[:n])


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and keys, columns whose names operators use themselves."""
    passage = prose(77, 70)
    rows = [
        (1, prose(1, 200), "en", "s"),
        (2, prose(1, 200), "en", "s"),
        (3, prose(1, 200) + " tail", None, "s"),
        (4, None, "en", None),
        (5, "", "en", "s"),
        (6, " \t\n\x0b ", "de", "s"),
        (7, "one two", "en", "s"),
        (7, "one two", "en", "s"),
        (8, "ONE two", "en", "s"),
        (None, prose(9, 120), None, None),
        (9, prose(9, 120), "en", "s"),
        (10, "x" * 5000, "en", "s"),
        (11, prose(11, 9000), "en", "s"),
        (12, prose(12, 80) + " " + passage + " " + prose(13, 80), "en", "s"),
        (13, passage + " " + prose(14, 60), "en", "s"),
        (14, "日本語 の テキスト é😀   x\x1cy", "ja", "s"),
        (15, "shti " * 120, "en", "s"),
        (16, prose(1, 199) + " changed", "en", "s"),
        (17, "the### of%%% " * 80, "en", "s"),
        (-5, prose(20, 60), "en", "s"),
        (11, prose(21, 60), "en", "s"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return frame.withColumns({n: F.lit("clash") for n in ("n_words", "kept", "c", "node", "root", "bucket", "__kept", "start", "value", "rank")}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)

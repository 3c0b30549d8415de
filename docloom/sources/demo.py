"""Made-up rows to try the engine with: the same for the same number and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INGEST, KINDS, SOURCES

THEMES = (
    ("retrieval", "A vector search over ten million rows", "We measured latency and recall of an index, and report where it fails."),
    ("training", "Fine-tuning on small data", "An ablation of learning rates; the training run took nine hours on one accelerator."),
    ("data", "Deduplication of a text dataset", "Near copies were a fifth of the corpus. However, some of them are quotations."),
    ("evaluation", "A benchmark that leaks", "Passages of the benchmark were found in the dataset, which explains the scores."),
)


def demo_rows(spark: SparkSession, now_ms: int, n: int = 36) -> DataFrame:
    """``n`` ingest rows with seq, an hour apart, over all sources and kinds; every sixth repeats the text of the row before under another address, every ninth is bait."""
    i = F.col("id")
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))
    repeat, bait = i % 6 == 5, i % 9 == 8
    of = i - F.when(repeat, 1).otherwise(0)
    title = F.when(bait, F.lit("You won't believe this!!! Follow me and RT")).otherwise(F.concat(pick([t for _, t, _ in THEMES], of), F.lit(", part "), of.cast("string")))
    body = F.when(bait, F.lit("Insane giveaway, DM me now!!!!!")).otherwise(F.concat(pick([b for *_, b in THEMES], of), F.lit(" Number "), of.cast("string"), F.lit(".")))
    null, handle = F.lit(None), F.concat(F.lit("author"), (i % 7).cast("string"))
    author = F.struct(*((handle if f.name in ("name", "handle") else null).cast(f.dataType).alias(f.name) for f in INGEST["author"].dataType))
    given = {
        "url": F.concat(F.lit("https://demo.example/item/"), i.cast("string")), "source": pick(SOURCES, i), "kind": pick(KINDS, i), "title": title, "content": body, "published_ms": F.lit(now_ms) - i * 3_600_000,
        "author": author, "topics": F.array(pick([t for t, *_ in THEMES], of)),
    }
    return spark.range(n).select(*(given.get(f.name, null).cast(f.dataType).alias(f.name) for f in INGEST), i.alias("seq"))

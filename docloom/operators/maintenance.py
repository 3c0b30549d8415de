"""Table sizes and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(items: DataFrame) -> DataFrame:
    """One row: items, canonical ones, vectors, sources, first and last capture."""
    return items.agg(F.count("*").alias("items"), F.count_if(F.col("duplicate_of").isNull()).alias("canonical"), F.count("embedding").alias("vectors"), F.count_distinct("source").alias("sources"), F.min("captured_ms").alias("first_ms"), F.max("captured_ms").alias("last_ms"))


def compact(items: DataFrame, path: str) -> None:
    """Rewrites a table by source, best items first in each file, so that scans of a source or of high scores skip most of it. Rows are spread evenly, a large source over many files."""
    even = items.hint("rebalance", "source").sortWithinPartitions("source", F.desc("score"))
    even.write.mode("overwrite").partitionBy("source").parquet(path)

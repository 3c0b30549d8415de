"""Pages by seek cursors over a table clustered by its sort order.

The table is cut into ranges of the order, each written by itself, and the first place of every range is kept. A cursor holds the sort key and the identifier of the last row seen, so a page begins after it: the ranges
before are not listed or read, none of their rows are sorted or dropped, and rows that come or go elsewhere don't shift it.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .storage import shared_path


def encode_place(key: float | None, id_: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([key, id_], separators=(",", ":")).encode()).decode().rstrip("=")


def decode_place(cursor: str | None) -> tuple[float | None, str] | None:
    """The place of a cursor; the beginning for anything malformed."""
    try:
        key, id_ = json.loads(base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)))
        return (None if key is None else float(key), id_) if isinstance(id_, str) else None
    except (ValueError, TypeError):
        return None


@dataclass(frozen=True)
class Clustered:
    """``parts``: for each range of the order its folder, its first place and its number of rows."""

    path: str
    key: str
    table: DataFrame
    parts: tuple[tuple[int, tuple, int], ...]

    @staticmethod
    def _place(key: float | None, id_: str) -> tuple:
        """A place as a tuple that sorts as the rows do: larger keys first, rows without a key last, then by identifier."""
        return (key is None, -(key or 0.0), id_)

    def _after(self, key: float | None, id_: str) -> Column:
        k, later = F.col(self.key), F.col("id") > id_
        if key is None:
            return k.isNull() & later
        return k.isNull() | (k < key) | (k == key) & later

    def page(self, limit: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """The next ``limit`` rows in order, and the cursor for what follows (null: nothing does)."""
        at = decode_place(cursor)
        start = max(0, bisect_right([first for _, first, _ in self.parts], self._place(*at)) - 1) if at else 0
        taken, rows = [], 0
        for i in range(start, len(self.parts)):
            taken.append(self.parts[i][0])
            rows += self.parts[i][2] if i > start or not at else 0  # of the first range a part has been seen
            if rows > limit:
                break
        order = (F.desc_nulls_last(self.key), F.asc("id"))
        rows_of = self.table.sparkSession.read.schema(StructType([f for f in self.table.schema if f.name != "__part"]))
        some = rows_of.parquet(*(f"{self.path}/__part={p}" for p in taken)) if taken else self.table.filter("false").drop("__part")
        found = (some.filter(self._after(*at)) if at else some).orderBy(*order)
        ends = found.select(self.key, "id").offset(max(limit - 1, 0)).limit(2).collect()  # the last row of the page, and the one after it
        return found.limit(limit), encode_place(ends[0][self.key], ends[0]["id"]) if len(ends) == 2 else None


def clustered(items: DataFrame, key: str, ranges: int = 200) -> Clustered:
    """``items`` (with ``id``, unique) in descending order of a numeric column, cut into about ``ranges`` ranges that a page can skip."""
    spark, path = items.sparkSession, shared_path(items.sparkSession, "clustered")
    order = (F.desc_nulls_last(key), F.asc("id"))
    rows = items.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    rows.write.partitionBy("__part").parquet(path)
    table = spark.read.schema(StructType([*items.schema.fields, StructField("__part", IntegerType())])).parquet(path)
    firsts = table.groupBy("__part").agg(F.min(F.struct(F.col(key).isNull(), -F.coalesce(F.col(key).cast("double"), F.lit(0.0)), F.col("id"))).alias("first"), F.count("*").alias("n"))
    parts = sorted(((r["__part"], tuple(r["first"]), r["n"]) for r in firsts.collect()), key=lambda p: p[1])  # a row a range
    return Clustered(path, key, table, tuple(parts))

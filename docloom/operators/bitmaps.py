"""Facets and conjunctions from a bitmap index: for every value of a dimension the rows that have it, as bitmaps in buckets.

Rows are numbered once (by their place in a written table, so that numbers stay); a bitmap covers the 32,768 numbers of one bucket. A filter is an AND of the bitmaps of its values, bucket by bucket, and the count of a facet
value under it the number of bits of another AND, so facets under many filters read the index only, never the items again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved


@dataclass(frozen=True)
class BitmapIndex:
    """``bitmaps``: dimension, value, bucket, bits (4,096 bytes); ``whole``: bucket, bits of all rows."""

    bitmaps: DataFrame
    whole: DataFrame

    def holding(self, wanted: list[tuple[str, str]]) -> DataFrame:
        """bucket, bits: the rows that have all the (dimension, value) pairs of ``wanted``; all rows if there are none. Buckets without such a row are left out."""
        if not wanted:
            return self.whole
        pairs = list(dict.fromkeys(wanted))
        some = self.bitmaps.filter(F.concat_ws("\x01", "dimension", "value").isin(*("\x01".join(p) for p in pairs)))
        return some.groupBy("bucket").agg(F.collect_list("bits").alias("all")).filter(F.size("all") == len(pairs)).select("bucket", "all").mapInArrow(_all_and, "bucket long, bits binary")

    def facets(self, wanted: list[tuple[str, str]], most: dict[str, int]) -> DataFrame:
        """facet, value, n: the most frequent values of each dimension among the rows that have all of ``wanted``; ties go to the smaller value."""
        inside = self.holding(wanted).select("bucket", F.col("bits").alias("inside"))
        counted = self.bitmaps.filter(F.col("dimension").isin(*most)).join(inside, "bucket").select("dimension", "value", "bits", "inside").mapInArrow(_counted, "dimension string, value string, n long")
        total = counted.groupBy("dimension", "value").agg(F.sum("n").alias("n")).filter("n > 0")
        turn = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
        limit = F.create_map(*(F.lit(x) for d, m in most.items() for x in (d, m)))[F.col("dimension")]
        return total.withColumn("turn", turn).filter(F.col("turn") <= limit).select(F.col("dimension").alias("facet"), "value", "n")


def _all_and(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [np.bitwise_and.reduce([np.frombuffer(x, np.uint8) for x in maps]) for maps in b.column(1).to_pylist()]
        keep = [i for i, x in enumerate(out) if x.any()]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([out[i].tobytes() for i in keep], pa.binary())], ["bucket", "bits"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [int(np.bitwise_count(np.frombuffer(x, np.uint64) & np.frombuffer(y, np.uint64)).sum()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["dimension", "value", "n"])


def bitmap_index(items: DataFrame, dimensions: dict[str, Column]) -> BitmapIndex:
    """Indexes values, strings or arrays of strings, of ``items``; null values and values that a row repeats count once at most."""
    kinds = items.select(*(c.alias(d) for d, c in dimensions.items())).schema
    values = [F.array_distinct(c) if kinds[d].dataType.simpleString().startswith("array") else F.array(c.cast("string")) for d, c in dimensions.items()]
    rows = saved(items.select(*(F.coalesce(v, F.array().cast("array<string>")).alias(d) for d, v in zip(dimensions, values, strict=True))).withColumn("__row", F.monotonically_increasing_id()))
    # A number is the place in a partition; partitions take turns of buckets, as the upper bits of the identifier name them.
    part, place = F.shiftright("__row", 33), F.col("__row").bitwiseAND((1 << 33) - 1)
    numbered = rows.withColumns({"bucket": (part * (1 << 18) + F.shiftright(place, 15)).cast("long"), "bit": place.bitwiseAND(32767).cast("long")})
    each = [numbered.select(F.lit(d).alias("dimension"), F.explode(d).alias("value"), "bucket", "bit") for d in dimensions]
    union = each[0]
    for e in each[1:]:
        union = union.union(e)
    bits = F.bitmap_construct_agg("bit").alias("bits")
    bitmaps = union.filter("value is not null").groupBy("dimension", "value", "bucket").agg(bits)
    return BitmapIndex(saved(bitmaps), saved(numbered.groupBy("bucket").agg(bits)))

"""Aggregates over items and the activity ledger. Time ranges are half-open; trash is left out everywhere; buckets are in UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def bucket_size(from_ms: int, to_ms: int, buckets: int) -> int:
    return max(HOUR_MS, -(-(to_ms - from_ms) // max(1, buckets)))


def bucket_count(days: int) -> int:
    return 24 if days <= 2 else 2 * days if days <= 14 else min(60, days)


def bucketed(at: Column, size: int | Column) -> Column:
    return (F.floor(at / size) * size).cast("long")


def between(at: Column, from_ms: int, to_ms: int) -> Column:
    return (at >= from_ms) & (at < to_ms)


def totals(rows: DataFrame, source: Column, score: Column, saved: Column, read: Column, seconds: Column) -> DataFrame:
    """One row: items, saved, read, reading seconds, sources, mean score."""
    return rows.agg(
        F.count("*").alias("items"),
        F.sum(F.when(saved, 1).otherwise(0)).alias("saved"),
        F.sum(F.when(read, 1).otherwise(0)).alias("read"),
        F.sum(F.when(read, seconds).otherwise(0)).alias("reading_sec"),
        F.count_distinct(source).alias("sources"),
        F.round(F.avg(score), 1).alias("mean_score"),
    )


def volume(rows: DataFrame, at: Column, size: int, score: Column) -> DataFrame:
    return rows.groupBy(bucketed(at, size).alias("bucket")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def by_key(rows: DataFrame, key: Column, score: Column, name: str = "key") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def top_authors(rows: DataFrame, author: Column, score: Column, limit: int = 12, most: int = 8) -> DataFrame:
    """Authors by mean score times their items, of which at most ``most`` count."""
    out = rows.groupBy(author.alias("author")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))
    return out.withColumn("weight", F.col("mean_score") * F.least(F.col("n"), F.lit(most))).orderBy(F.desc("weight"), "author").limit(limit)


def entity_counts(items: DataFrame, limit: int = 40) -> DataFrame:
    return items.select(F.explode("entities").alias("e")).groupBy("e.name", "e.type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name", "type").limit(limit)


def histogram(rows: DataFrame, score: Column, width: int = 10) -> DataFrame:
    return rows.groupBy((F.floor(score / width) * width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def topic_trends(rows: DataFrame, topic: Column, at: Column, from_ms: int, to_ms: int, limit: int = 20) -> DataFrame:
    """Topics of a window against the window before: total, previous, momentum, is_new, ordered by momentum times ln(1 + total). Both windows are one scan and one aggregate."""
    span = to_ms - from_ms
    current, before = between(at, from_ms, to_ms), between(at, from_ms - span, from_ms)
    both = rows.filter(current | before).groupBy(topic.alias("topic")).agg(F.sum(current.cast("long")).alias("total"), F.sum(before.cast("long")).alias("previous"))
    known = both.select(F.sum("previous")).first()[0] or 0  # one number
    momentum = F.round((F.col("total") + 2) / (F.col("previous") + 2), 2) if known else F.lit(1.0)
    top = both.filter("total > 0").orderBy(F.desc("total"), "topic").limit(limit)
    out = top.withColumn("momentum", momentum).withColumn("is_new", (F.col("previous") == 0) & F.lit(known > 0))
    return out.withColumn("heat", F.col("momentum") * F.log1p(F.col("total").cast("double"))).orderBy(F.desc("heat"), "topic")


def series(rows: DataFrame, key: Column, at: Column, size: int, name: str = "key") -> DataFrame:
    return rows.groupBy(key.alias(name), bucketed(at, size).alias("bucket")).agg(F.count("*").alias("n"))


def top_per(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their turn. Limited before the shuffle, too."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("turn") <= n)


def heatmap(ledger: DataFrame, at: Column, kind: Column, kinds: tuple[str, ...]) -> DataFrame:
    """Events by day of week (Sunday 0) and hour."""
    return ledger.filter(kind.isin(*kinds)).groupBy((F.dayofweek(at) - 1).alias("dow"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))


def daily(ledger: DataFrame, at: Column, kind: Column, kinds: dict[str, str]) -> DataFrame:
    """Events of each of ``kinds`` (name: kind) by day."""
    return ledger.groupBy(F.to_date(at).alias("day")).agg(*(F.sum((kind == k).cast("long")).alias(name) for name, k in kinds.items()))


def _named(name: str) -> Callable[[Column], Column]:
    return lambda value: F.struct(F.lit(name).alias("facet"), value.alias("value"))


def facets(rows: DataFrame, dimensions: dict[str, tuple[Column, int]]) -> DataFrame:
    """facet, value, n: the most frequent values of each dimension (column or array, limit), in one scan."""
    pairs = []
    for name, (c, _) in dimensions.items():
        values = c if rows.select(c.alias("x")).schema["x"].dataType.typeName() == "array" else F.array(c)
        pairs.append(F.transform(values.cast("array<string>"), _named(name)))
    counted = rows.select(F.explode(F.flatten(F.array(*pairs))).alias("p")).filter("p.value is not null").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))
    turn = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    limit = F.create_map(*(F.lit(x) for name, (_, n) in dimensions.items() for x in (name, n)))
    return counted.withColumn("turn", turn).filter(F.col("turn") <= limit[F.col("facet")]).drop("turn")


def state_counts(rows: DataFrame, state: Column, states: tuple[str, ...], flags: dict[str, Column] | None = None) -> DataFrame:
    """One row: a count for each state and flag."""
    return rows.agg(*(F.count_if(state == s).alias(s) for s in states), *(F.count_if(c).alias(n) for n, c in (flags or {}).items()))

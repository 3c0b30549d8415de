"""Streaming operators. Event time must be ``timestamp``: zone-less times are cast, in the session's zone, before a watermark is set."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def timed(events: DataFrame, time: str = "ts", late: str = LATE) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, key: str, size: str = "6 hours", time: str = "ts", value: str | None = None, late: str = LATE) -> DataFrame:
    """Counts (and sums of ``value``) of each key in fixed windows."""
    extra = [F.sum(value).alias("total")] if value else []
    return timed(events, time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"), *extra).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", *(["total"] if value else []))


def sliding(events: DataFrame, key: str, size: str = "6 hours", step: str = "3 hours", time: str = "ts", late: str = LATE) -> DataFrame:
    return timed(events, time, late).groupBy(F.window(time, size, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts", late: str = LATE) -> DataFrame:
    """Sessions of each key, ended by a gap."""
    return timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def unique_events(events: DataFrame, keys: list[str], time: str = "ts", late: str = LATE) -> DataFrame:
    """The first event of each key within the watermark; state is bounded by it."""
    return timed(events, time, late).dropDuplicatesWithinWatermark(keys)


def echo_stream(left: DataFrame, right: DataFrame, key: str, time: str = "ts", span: str = "72 hours", late: str = LATE) -> DataFrame:
    """Pairs of two streams (id, key, time) of equal key within ``span``; both sides' state is bounded by watermark and span."""
    a = timed(left, time, late).select(F.col("id").alias("a"), F.col(key).alias("a_key"), F.col(time).alias("a_time"))
    b = timed(right, time, late).select(F.col("id").alias("b"), F.col(key).alias("b_key"), F.col(time).alias("b_time"))
    near = F.expr(f"b_time BETWEEN a_time - INTERVAL {span} AND a_time + INTERVAL {span}")
    return a.join(b, (F.col("a_key") == F.col("b_key")) & near & (F.col("a") != F.col("b")))


def _first_seen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, full = state.exists, bool(state.exists and state.get[0])
    for rows in batches:
        for i in range(len(rows)):
            has = bool(rows["full"].iloc[i])
            if not known or (has and not full):
                known, full = True, full or has
                yield rows.iloc[i : i + 1].astype(object)
    state.update((full,))


def first_seen(rows: DataFrame) -> DataFrame:
    """Rows (url, full, ...) of a stream: the first of each URL, and one upgrade to a full body. State is one flag a URL; where URLs never end, ``first_seen_within`` forgets those not seen for a span."""
    return rows.groupBy("url").applyInPandasWithState(_first_seen, rows.schema, "full boolean", "append", GroupStateTimeout.NoTimeout)


def last_observation(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of a micro-batch, the last row of each key."""
    latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r"))
    return latest.select("r.*")


def new_item_events(rows: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, every: str = "250 milliseconds", most_ids: int = 200) -> StreamingQuery:
    """One summary row a micro-batch of new items (id, score): count, ids (``most_ids`` at most), best score."""

    def emit(batch: DataFrame, number: int) -> None:
        best = batch.orderBy(F.desc("score"), "id").limit(most_ids).agg(F.collect_list("id").alias("ids"))
        summary = batch.agg(F.count("*").alias("n"), F.max("score").alias("max_score")).filter("n > 0").crossJoin(best)  # one row each
        sink(summary.withColumn("batch", F.lit(number)))

    return rows.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def ingest_stream(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, key: str = "url", order: str = "seq", once: bool = True) -> StreamingQuery:
    """A stream of ingest rows into ``handle(batch, number)``: of each micro-batch, the last observation of every URL. ``handle`` must be idempotent in ``number``."""

    def emit(batch: DataFrame, number: int) -> None:
        handle(last_observation(batch, [key], order), number)

    writer = rows.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="1500 milliseconds").start()

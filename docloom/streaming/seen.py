"""Sightings of URLs in a stream, remembered for a span of event time only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from .streams import LATE

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _condensed(span: int, order: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch and run of a URL (its times less than ``span`` apart) the first row, the first full one and the last; the first stands for all times up to ``_until``.

    Runs merge in any order to the runs of the whole, so a URL that has a third of all rows is few rows after this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("url", "ascending"), *order], null_placement="at_start"))
            at, full = rows.column("_at").to_pandas(), rows.column("full").to_pandas().astype(bool)
            url = rows.column("url").to_pandas()
            new = (url != url.shift()) | (at - at.shift() >= span)
            runs = new.cumsum()
            upgrade = full & (full.groupby(runs).cumsum() == 1)
            until = at.where(~new, at.groupby(runs).transform("max"))
            place = rows.schema.get_field_index("_until")
            rows = rows.set_column(place, rows.schema.field(place), pa.array(until, pa.int64()))
            yield rows.filter(pa.array(new | upgrade | (runs != runs.shift(-1)), pa.bool_()))

    return run


class Sightings(StatefulProcessor):
    """State of a URL: its last time and whether a full body was seen. A timer ends it ``span`` after that time, when no row that is not late can continue it.

    Rows are (time, until, full, the columns that break ties, the given row).
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "last long, full boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        last, had = (known[0], known[1]) if known is not None else (None, False)
        for row in sorted(rows, key=lambda r: (r["_at"], not r["full"], [(v is not None, v) for v in r["_ties"]])):
            at, full = row["_at"], row["full"]
            new = last is None or at - last >= self.span
            if new or (full and not had):
                had = full
                yield Row(row=row["_row"])
            last = row["_until"] if last is None else max(last, row["_until"])
        if known is None or known[0] != last:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.span) // 1000 + 1)
        self.state.update((last, had))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen_within(rows: DataFrame, span: str = "30 days", time: str = "ts", late: str = LATE, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows (url, full, ``time``, ...) of a stream: the first of each URL, and one upgrade to a full body; a URL not seen for ``span`` is new again, and its state is gone.

    Rows of one time are taken full bodies first, then by ``ties``; of equal rows one is given. A null ``full`` is false; rows without URL or time sight nothing and give no row.
    Rows later than ``late``, or not after 1970, are dropped, as by any watermark. The stream must be started with ``keeping_state``.
    """
    length = int(rows.sparkSession.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {span}"))).first()[0])
    given = rows.withColumn(time, F.col(time).cast("timestamp")).withColumn("full", F.coalesce("full", F.lit(False))).filter(F.col("url").isNotNull() & F.col(time).isNotNull())
    order = [(f"_tie{i}", "ascending") for i in range(len(ties))]
    at = F.unix_micros(F.col(time))
    apart = given.select("url", F.col(time).alias("_time"), at.alias("_at"), at.alias("_until"), "full", *(F.col(c).alias(n) for c, (n, _) in zip(ties, order, strict=True)), F.struct(*given.columns).alias("_row"))
    few = apart.mapInArrow(_condensed(length, [("_at", "ascending"), ("full", "descending"), *order]), apart.schema).withColumn("_ties", F.struct(*(n for n, _ in order)) if order else F.struct(F.lit(0)))
    found = few.withWatermark("_time", late).groupBy("url").transformWithState(Sightings(length), StructType([StructField("row", given.schema)]), "append", "EventTime")
    return found.select("row.*")


def keeping_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a stream with the state store that timers need; a stream keeps the settings it is started with, the session's own are put back."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(STATE_STORE, before)

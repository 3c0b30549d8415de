"""One tick of the refresh of sources: what is due is fetched, errors stay with their source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.library import due, record_run

Fetch = Callable[[dict], DataFrame]
RUNS = "id string, ran_ms long, added long, error string"


def tick(sources: DataFrame, now_ms: int, fetch: Fetch, handle: Callable[[dict, DataFrame], int], most: int = 50) -> DataFrame:
    """The sources table after a tick. ``fetch`` gives a source's rows, ``handle`` takes them and gives how many were new; at most ``most`` sources a tick, those that waited longest first."""
    runs = []
    for row in due(sources, now_ms).orderBy("last_run_ms", "id").limit(most).collect():
        source, added, error = row.asDict(recursive=True), 0, None
        try:
            added = int(handle(source, fetch(source)))
        except Exception as e:  # noqa: BLE001  a failing source must not stop the others
            error = f"{type(e).__name__}: {e}"[:500]
        runs.append((source["id"], now_ms, added, error))
    return record_run(sources, sources.sparkSession.createDataFrame(runs, RUNS))

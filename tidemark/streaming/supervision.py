"""Keeping streams running: restarts with growing pauses, a watchdog for silence, late rows counted, a callback on each batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def supervised(start: Callable[[], StreamingQuery], attempts: int | None = None, first_s: float = 1.0, most_s: float = 60.0, healthy_s: float = 300.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, log: Callable[[str], None] = print) -> int:
    """Runs a query until it is stopped, starting it anew from its checkpoint whenever it fails; returns the number of restarts.

    Pauses double up to `most_s` and begin anew after a run of `healthy_s`. After `attempts` restarts the failure is raised.
    """
    pause, restarts = first_s, 0
    while True:
        began = clock()
        try:
            start().awaitTermination()
            return restarts
        except Exception as e:
            if attempts is not None and restarts >= attempts:
                raise
            if clock() - began >= healthy_s:
                pause = first_s
            log(f"stream failed, again in {pause:g} s: {type(e).__name__}")
        sleep(pause)
        pause, restarts = min(pause * 2, most_s), restarts + 1


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful steps have dropped as later than the watermark, over the progress that the query still holds."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def stalled(query: StreamingQuery, silent_batches: int) -> bool:
    """Whether the last batches have brought no row, or the query is no longer active."""
    last = query.recentProgress[-silent_batches:]
    return not query.isActive or (len(last) == silent_batches and all(p["numInputRows"] == 0 for p in last))


def each_snapshot(rows: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls back with every batch and its number; a batch given again after a failure has the number it had."""
    return rows.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).start()

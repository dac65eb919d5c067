"""The batch folds as streams: bars with a watermark, and a stateful touch per instrument."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, key: str, bar: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (key, time, ts, seq, price, size): emitted once the watermark has passed their end; later ticks are dropped.

    A bar ends with its end, as the batch fold's: windows are taken a millisecond earlier, at the ticks' resolution.
    """
    order = F.struct("ts", "seq")
    b = ticks.withColumn("time", F.col("time") - F.expr("INTERVAL 1 MILLISECOND")).withWatermark("time", late).groupBy(key, F.window("time", bar)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    return b.select(key, F.col("window.end").alias("end"), "open", "high", "low", "close", "volume", "n")


def sliding_sums(ticks: DataFrame, key: str, length: str, step: str, late: str = "10 minutes") -> DataFrame:
    """(key, end, size, n) of overlapping windows of a stream."""
    w = ticks.withWatermark("time", late).groupBy(key, F.window("time", length, step)).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("window.end").alias("end"), "size", "n")


def sessions(ticks: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of a key's events with no pause of `gap`; end is the last event's time plus the gap."""
    w = ticks.withWatermark("time", late).groupBy(key, F.session_window("time", gap)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events of a stream without those seen before within the watermark; state goes with it."""
    return events.withWatermark("time", late).dropDuplicatesWithinWatermark(keys)


def labelled(rows: DataFrame, ticks: DataFrame, key: str, horizon: str, late: str = "10 minutes") -> DataFrame:
    """Rows of a stream (key, time, ...) with their label, released once the stream of ticks has passed their horizon.

    The label is the price of the last tick in the horizon; state of both sides ends with the watermark.
    """
    r = rows.withWatermark("time", late).alias("r")
    t = ticks.select(F.col(key).alias("_key"), F.col("time").alias("_time"), F.col("price").alias("_price"), F.col("seq").alias("_seq")).withWatermark("_time", late)
    on = (F.col(f"r.{key}") == F.col("_key")) & (F.col("_time") > F.col("r.time")) & (F.col("_time") <= F.col("r.time") + F.expr(f"INTERVAL {horizon}"))
    j = r.join(t, on, "inner")
    return j.groupBy(key, F.window("time", "1 millisecond"), "price").agg(F.max_by("_price", F.struct("_time", "_seq")).alias("label")).select(key, F.col("window.start").alias("time"), "price", "label")


def idempotent_sink(path: str):
    """A foreachBatch function: each batch has its own folder, so that a batch given again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def stream_changes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of a stream whose value differs from the key's last one; rows not later than the last one kept are dropped."""
    kind = dict(rows.dtypes)[value]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ts, last = state.get if state.exists else (-1, None)
        for pdf in batches:
            out = []
            for t, v in sorted(zip(pdf["ts"], pdf[value], strict=True)):
                if t > ts and v != last:
                    out.append((k[0], t, v))
                    ts, last = t, v
            state.update((int(ts), last))
            yield pd.DataFrame(out, columns=[key, "ts", value])

    schema = f"{key} {dict(rows.dtypes)[key]}, ts long, {value} {kind}"
    return rows.groupBy(key).applyInPandasWithState(run, schema, f"ts long, last {kind}", "append", "NoTimeout")

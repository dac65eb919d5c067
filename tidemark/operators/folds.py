"""Folds of ticks into bars and of bars into coarser ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bar_end(ts: str | Column, bar_ms: int) -> Column:
    """End of the bar that holds ts: an exact boundary belongs to the bar that ends there."""
    return F.expr(f"((({ts}) - 1) div {bar_ms} + 1) * {bar_ms}")


def fold_ticks(ticks: DataFrame, key: str, bar_ms: int) -> DataFrame:
    """(key, ts of bar end, open, high, low, close, volume, taker, n); ties in ts are settled by seq. Partial sums before the shuffle."""
    order = F.struct("ts", "seq")
    buys = F.when(F.col("is_buy"), F.col("size")).otherwise(0.0)
    return ticks.groupBy(key, bar_end("ts", bar_ms).alias("bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.sum(buys).alias("taker"), F.count(F.lit(1)).alias("n"),
    ).withColumnRenamed("bar", "ts")


def fold_bars(bars: DataFrame, key: str, bar_ms: int) -> DataFrame:
    """Bars into coarser ones, with the realised volatility of the steps inside each (bps) and the number of bars.

    Repeated stamps count once, the first of them by close.
    """
    w = Window.partitionBy(key, bar_end("ts", bar_ms)).orderBy("ts")
    step = F.log(F.col("close") / F.lag("close").over(w))
    b = bars.dropDuplicates([key, "ts"]).withColumn("bar", bar_end("ts", bar_ms)).withColumn("step", step)
    return b.groupBy(key, "bar").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        (F.sum("taker") / F.sum("volume")).alias("taker_frac"), F.count(F.lit(1)).alias("bars"), (F.sqrt(F.coalesce(F.sum(F.col("step") * F.col("step")), F.lit(0.0))) * 1e4).alias("rv_bps"),
    ).withColumnRenamed("bar", "ts")


def settlements_by_bar(funding: DataFrame, key: str, bar_ms: int) -> DataFrame:
    """Funding settlements summed into the bar that ends at or after them."""
    return funding.groupBy(key, bar_end("ts", bar_ms).alias("bar")).agg(F.sum("bps").alias("funding_bps"), F.count(F.lit(1)).alias("periods")).withColumnRenamed("bar", "ts")


def daily_funding(funding: DataFrame, key: str) -> DataFrame:
    """Settlements by UTC day, stamps rounded to the minute and a millisecond less: midnight belongs to the day before."""
    day = F.expr("(((ts + 30000) div 60000) * 60000 - 1) div 86400000")
    return funding.groupBy(key, day.alias("day")).agg(F.sum("bps").alias("bps"), F.count(F.lit(1)).alias("periods"))

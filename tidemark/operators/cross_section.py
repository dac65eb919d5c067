"""Per-time transforms over symbols, and the long/short books made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.moments import corr


def ordinal_rank(score: str, at: str = "t", symbol: str = "symbol") -> Column:
    """Place among the names of a time, scaled to [-1, 1]; ties in the order of symbols; a single name is 0."""
    n = F.count(score).over(Window.partitionBy(at))
    r = F.row_number().over(Window.partitionBy(at).orderBy(score, symbol))
    return F.when(F.col(score).isNotNull(), F.when(n == 1, 0.0).otherwise(2.0 * (r - 1) / (n - 1) - 1))


def average_rank(score: str, *by: str) -> Column:
    """1-based rank, ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2


def demean(value: str, eligible: Column | None = None, at: str = "t") -> Column:
    """value less the mean of the (eligible) names of its time."""
    over = Window.partitionBy(at)
    return F.col(value) - F.avg(F.when(eligible, F.col(value)) if eligible is not None else F.col(value)).over(over)


def rank_blend(df: DataFrame, weights: dict[str, float], at: str = "t", symbol: str = "symbol") -> DataFrame:
    """df with `blend`: weighted ordinal ranks scaled to [0, 1] among rows that have all inputs; null elsewhere."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in weights])
    ok = df.withColumn("_ok", whole)
    n = F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(Window.partitionBy(at))
    ranks = [(F.row_number().over(Window.partitionBy(at, "_ok").orderBy(c, symbol)) - 1) / F.greatest(n - 1, F.lit(1)) * w for c, w in weights.items()]
    return ok.withColumn("blend", F.when(F.col("_ok"), reduce(lambda a, b: a + b, ranks))).drop("_ok")


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(x, 0)


def book(df: DataFrame, score: str, share: float = 0.3, least: int = 6, at: str = "t", symbol: str = "symbol") -> DataFrame:
    """(at, symbol, weight): the top and bottom share of each time's scored names, each side's weights summing to 1.

    Times with fewer than `least` names have no book. Sides that would overlap are halved.
    """
    s = df.where(F.col(score).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(at))).where(F.col("_n") >= least)
    side = F.greatest(F.lit(1.0), half_even(F.col("_n") * share))
    side = F.when(2 * side > F.col("_n"), F.floor(F.col("_n") / 2)).otherwise(side)
    s = s.withColumn("_r", F.row_number().over(Window.partitionBy(at).orderBy(score, symbol))).withColumn("_k", side)
    weight = F.when(F.col("_r") > F.col("_n") - F.col("_k"), 1.0 / F.col("_k")).when(F.col("_r") <= F.col("_k"), -1.0 / F.col("_k"))
    return s.withColumn("weight", weight).where("weight is not null").select(at, symbol, "weight")


def turnover(weights: DataFrame, step: int, at: str = "t", symbol: str = "symbol") -> DataFrame:
    """Sum of absolute weight changes from the book one step before, by time; the first book counts whole."""
    now = weights.select(at, symbol, F.col("weight").alias("w"))
    was = weights.select((F.col(at) + step).alias(at), symbol, F.col("weight").alias("v"))
    times = weights.select(at).distinct()
    j = now.join(was, [at, symbol], "full").join(times, at, "left_semi").fillna(0.0, ["w", "v"])
    return j.groupBy(at).agg(F.sum(F.abs(F.col("w") - F.col("v"))).alias("turnover"))


def factor_run(panel: DataFrame, score: str, hold: int, share: float = 0.3, cost_bps: float = 10.0, at: str = "t", symbol: str = "symbol") -> DataFrame:
    """Per non-overlapping period: gross (excess over the eligible mean, funding paid), turnover, net, and the score's IC.

    panel has one row per time and name with close, funding and the score. A period starts every `hold` times from the
    first. Names without a forward return drop out and each side is rebalanced. Figures are per unit of gross, so halved.
    """
    o = Window.partitionBy(symbol).orderBy(at)
    start = panel.agg(F.min(at).alias("_start"))
    ahead = F.lead("close", hold).over(o)
    whole = F.lead(at, hold).over(o) == F.col(at) + hold
    paid = F.sum(F.coalesce(F.col("funding"), F.lit(0.0))).over(o.rowsBetween(1, hold))
    p = panel.withColumn("_fwd", F.when(whole, F.log(ahead / F.col("close")) * 1e4 - paid))
    p = p.join(F.broadcast(start)).where((F.col(at) - F.col("_start")) % hold == 0).drop("_start")
    # One shuffle by time: the sides, the eligible names' mean, each side's scale and the ranks are windows over it.
    by = Window.partitionBy(at)
    p = p.where(F.col(score).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(by)).where("_n >= 6")
    side = F.greatest(F.lit(1.0), half_even(F.col("_n") * share))
    p = p.withColumn("_k", F.when(2 * side > F.col("_n"), F.floor(F.col("_n") / 2)).otherwise(side)).withColumn("_r", F.row_number().over(by.orderBy(score, symbol)))
    sign = F.when(F.col("_r") > F.col("_n") - F.col("_k"), 1.0).when(F.col("_r") <= F.col("_k"), -1.0)
    d = p.withColumn("_s", sign).where(F.col("_fwd").isNotNull()).withColumn("_x", demean("_fwd", at=at))
    names = lambda v: F.sum(F.when(F.col("_s") == v, 1.0)).over(by)
    d = d.withColumn("_w", F.when(F.col("_s") > 0, 1.0 / names(1.0)).when(F.col("_s") < 0, -1.0 / names(-1.0)))
    ranked = d.withColumn("_a", average_rank(score, at)).withColumn("_b", average_rank("_x", at))
    g = ranked.groupBy(at).agg(F.sum(F.col("_w") * F.col("_x")).alias("gross"), F.when(F.count(F.lit(1)) >= 6, corr("_a", "_b")).alias("ic")).where("gross is not null")
    # A book's weights count at its own time and, to be taken off, at the next one.
    legs = F.explode(F.array(F.struct(F.col(at).alias("_t"), F.col("_w").alias("now"), F.lit(0.0).alias("was")), F.struct((F.col(at) + hold).alias("_t"), F.lit(0.0).alias("now"), F.col("_w").alias("was"))))
    m = d.where("_w is not null").select(symbol, legs.alias("_l")).select(symbol, "_l.*").groupBy("_t", symbol).agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    m = m.groupBy("_t").agg(F.sum(F.abs(F.col("now") - F.col("was"))).alias("turnover"))
    out = g.join(m, g[at] == m["_t"])
    return out.select(at, (F.col("gross") / 2).alias("gross"), (F.col("turnover") / 2).alias("turnover"), ((F.col("gross") - F.col("turnover") * cost_bps) / 2).alias("net"), "ic")

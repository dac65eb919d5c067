"""Which names may be held, how wild their prices are, and the factor libraries ranks are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.ieee import ln, ratio
from tidemark.operators import joins
from tidemark.operators import windows as W


def tradeable(panel: DataFrame, key: str, at: str, least_run: int, least_volume: float, window: int) -> DataFrame:
    """(key, at, run, median_volume, eligible) on a dense grid: whole for least_run steps and a median volume of least_volume.

    Only rows up to each time count; the first `window` times of a name are never eligible.
    """
    dense = joins.scaffold(panel.select(key, at, "volume", "complete"), key, at, 1).withColumn("complete", F.coalesce("complete", F.lit(False)))
    o = W.ordered(key, at)
    p = W.unbroken_run(dense, key, at, "complete").withColumn("median_volume", F.percentile("volume", 0.5).over(o.rowsBetween(1 - window, 0)))
    ok = (F.row_number().over(o) > window) & (F.col("run") >= least_run) & (F.col("median_volume") >= least_volume)
    return p.select(key, at, "run", "median_volume", F.coalesce(ok, F.lit(False)).alias("eligible"))


def regime_of_prior(over: WindowSpec, rv: str, window: int, least: int) -> Column:
    """Regime by the share of the `window` values before the current one that are below it; unknown under `least` of them."""
    past = F.collect_list(rv).over(over.rowsBetween(-window, -1))
    share = F.size(F.filter(past, lambda x: x < F.col(rv))) / F.size(past)
    return F.when(F.size(past) < least, "unknown").when(share < 1 / 3, "low").when(share > 2 / 3, "high").otherwise("normal")


def regime_of_samples(over: WindowSpec, rv: str, window: int, least: int) -> Column:
    """Regime against the 33rd and 67th of a hundred of the last `window` positive values, the current one included."""
    seen = F.sort_array(F.filter(F.collect_list(F.when(F.col(rv) > 0, F.col(rv))).over(over.rowsBetween(1 - window, 0)), lambda x: x > 0))
    pick = lambda q: F.get(seen, F.floor(F.size(seen) * q).cast("int"))
    return F.when(F.size(seen) < least, "unknown").when(F.col(rv) <= pick(0.33), "low_vol").when(F.col(rv) >= pick(0.67), "high_vol").otherwise("normal_vol")


def with_market(df: DataFrame, at: str, ret: str) -> DataFrame:
    """df with `market`, the mean return of a time's names."""
    return df.withColumn("market", F.avg(ret).over(Window.partitionBy(at)))


def trailing_beta(over: WindowSpec, ret: str, w: int) -> Column:
    """Slope of a name's return on `market` over w rows with both; null before that, or where the market stands still."""
    r = over.rowsBetween(1 - w, 0)
    var = F.var_pop("market").over(r)
    return F.when((F.count(ret).over(r) == w) & (var > 0), F.covar_pop(ret, "market").over(r) / var)


def daily_factors(panel: DataFrame, key: str = "symbol", at: str = "t") -> DataFrame:
    """The daily factor library; panel has close, high, low, volume, taker, funding and rv. High always means expected to do better."""
    o = W.ordered(key, at)
    p = with_market(panel.withColumn("ret", W.log_return(o, "close", 1)), at, "ret")
    p = p.withColumn("_illiq", F.when(F.col("volume") > 0, F.abs("ret") / F.col("volume"))).withColumn("_small", F.when(F.col("volume") > 0, -F.log("volume")))
    std = W.trailing_std(o, "ret", 30)
    carry = {w: -W.trailing_sum(o, "funding", w) / w for w in (1, 3, 7, 14, 30, 60)}
    mom = {w: W.log_return(o, "close", w) for w in (1, 3, 7, 14, 30)}
    after = lambda w, x: F.when(F.row_number().over(o) > w, x)
    hi, lo = F.max("high").over(o.rowsBetween(-29, 0)), F.min("low").over(o.rowsBetween(-29, 0))
    out = {f"carry_{w}": c for w, c in carry.items()} | {f"mom_{w}": mom[w] for w in (7, 14, 30)} | {f"rev_{w}": -mom[w] for w in (1, 3)}
    out |= {
        "lowvol_30": -std, "lowrv_30": -W.trailing_mean(o, "rv", 30), "illiq_30": W.trailing_mean(o, "_illiq", 30), "small_30": W.trailing_mean(o, "_small", 30),
        "taker_7": W.trailing_mean(o, "taker", 7), "rangepos_30": after(30, F.when(hi > lo, -(F.col("close") - lo) / (hi - lo))),
        "rvshock_7": -W.trailing_mean(o, "rv", 7) / W.trailing_mean(o, "rv", 30), "carry_accel": carry[3] - carry[30], "max_7": -W.full(F.max("ret"), o, 7, -6, 0),
        "beta_30": after(30, -trailing_beta(o, "ret", 30)), "skew_30": after(30, -W.trailing_skew(o, "ret", 30)), "volshock_1": -F.log(F.col("volume") / W.trailing_mean(o, "volume", 30)),
        "carry_vol": carry[7] / std, "mom_vol": mom[14] / std,
    }
    return p.select(key, at, *[c.alias(n) for n, c in out.items()])


def oi_factors(df: DataFrame, key: str, at: str) -> DataFrame:
    """Open-interest factors; df has close, volume and oi."""
    o = W.ordered(key, at)
    change = lambda k: F.log(F.col("oi") / F.lag("oi", k).over(o))
    sign = lambda k: F.signum(F.log(F.col("close") / F.lag("close", k).over(o)))
    day, month = W.trailing_mean(o, "volume", 24), W.trailing_mean(o, "volume", 30)
    return df.select(
        key, at, *[change(k).alias(f"doi_{k}") for k in (1, 4, 24)], *[(-sign(k) * change(k)).alias(f"newlongs_{k}") for k in (1, 24)],
        (-F.log(F.col("oi") / month)).alias("oi_lvl"), (-F.abs(F.col("oi") - F.lag("oi", 24).over(o)) / day).alias("oi_vol"),
    )


def range_dataset(bars: DataFrame, key: str, step: int, look: int, horizon: int) -> DataFrame:
    """Ten features of the trailing range and three targets of the coming one, rows whose windows have no hole.

    Trailing windows end before the current bar; the long one is four times the look-back, the short one a sixth of it.
    """
    o, far, short = W.ordered(key), 4 * look, max(1, look // 6)
    e = 1e-12
    b = bars.withColumn("_r2", F.pow(F.coalesce(ln(ratio("close", F.lag("close").over(o))), F.lit(0.0)), 2)).withColumn("_p2", F.pow(ln(ratio("high", "low")), 2))
    b = b.withColumns({"_hi": W.full(F.max("high"), o, look, -look, -1), "_lo": W.full(F.min("low"), o, look, -look, -1), "_hi4": W.full(F.max("high"), o, far, -far, -1), "_lo4": W.full(F.min("low"), o, far, -far, -1)})
    b = b.withColumns({"_fh": W.full(F.max("high"), o, horizon, 1, horizon), "_fl": W.full(F.min("low"), o, horizon, 1, horizon), "_was": F.lag("close", look).over(o)})
    b = b.withColumns({"_rv": F.sqrt(W.trailing_mean_before(o, "_r2", look)), "_rvs": F.sqrt(W.trailing_mean_before(o, "_r2", short)), "_pk": F.sqrt(W.trailing_mean_before(o, "_p2", look) / (4 * 0.6931471805599453))})
    b = b.withColumn("_ok", W.contiguous_back(o, "ts", step, far) & W.contiguous_forward(o, "ts", step, horizon)).where("_ok and _hi > _lo and _hi4 > _lo4")
    width, ret = ln(ratio("_hi", "_lo")), ln(ratio("close", "_was"))
    return b.select(
        key, "ts", width.alias("log_width"), F.log(F.col("_rv") + e).alias("rv"), F.log(F.col("_pk") + e).alias("parkinson"), ln(ratio(F.col("_rvs") + e, F.col("_rv") + e)).alias("vol_ratio"), ret.alias("ret"),
        ((F.col("close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).alias("pos_in_range"), ln(ratio("_hi", "close")).alias("dist_high"), ln(ratio("close", "_lo")).alias("dist_low"),
        ratio(F.abs(ret), width).alias("trend_ratio"), ln(ratio(width, ln(ratio("_hi4", "_lo4")))).alias("width_ratio"), ln(ratio(F.sqrt(F.col("_fh") * F.col("_fl")), "close")).alias("centre"),
        ln(ratio("_fh", "_fl")).alias("width"), ((F.col("_fh") <= F.col("_hi")) & (F.col("_fl") >= F.col("_lo"))).cast("double").alias("contained"),
    )


def sideways(days: DataFrame, key: str, at: str, w: int) -> DataFrame:
    """The last w days of each key against all of its w-day windows: move, width, trend, and shares of windows at or below them."""
    o = W.ordered(key, at)
    r, was = o.rowsBetween(1 - w, 0), F.lag("close", w).over(o)
    d = days.withColumns({"_hi": F.max("high").over(r), "_lo": F.min("low").over(r), "_was": was}).where("_was is not null")
    span = F.col("_hi") - F.col("_lo")
    d = d.withColumn("trend", F.when(span > 0, F.abs(F.col("close") - F.col("_was")) / span).otherwise(float("inf"))).withColumn("width", span / ((F.col("_hi") + F.col("_lo")) / 2)).withColumn("move", F.col("close") / F.col("_was") - 1)
    last = d.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in ("move", "width", "trend")])
    share = lambda c: F.avg(F.when(F.col(f"a.{c}") <= F.col(f"b.{c}"), 1.0).otherwise(0.0)).alias(f"{c}_share")
    return d.alias("a").join(last.alias("b"), key).groupBy(key).agg(F.first("b.move").alias("move"), F.first("b.width").alias("width"), F.first("b.trend").alias("trend"), share("trend"), share("width"), F.count(F.lit(1)).alias("windows"))

"""What several venues say of one coin: listings, screens, candles, fees, depth, trades on a leader's lead, books side by side, and a made-up path to hold studies against."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions.draws import digest
from tidemark.functions.ieee import ratio
from tidemark.functions.moments import corr
from tidemark.operators import joins
from tidemark.operators import windows as W
from tidemark.operators.sequential import non_overlapping

# How a listing is announced, and the multiples a small coin is quoted in.
NOT_A_LISTING = "Alpha"
SPOT_TITLE, SPOT_TICKER = "Binance Will List ", r"\(([A-Z0-9]+)\)"
FUTURES_TITLE, FUTURES_TICKER = "(?i)Binance Futures Will Launch ", r"\b([A-Z0-9]+)USDT\b"
MULTIPLES = ("", "1000", "10000")

# Maker and taker fee in bps by tier; the fourth isn't known.
FEES = {0: (2.0, 6.0), 1: (0.6, 5.0), 2: (0.4, 4.5), 3: (0.2, 4.25), 5: (0.0, 3.5)}


def announced(df: DataFrame, title: str) -> DataFrame:
    """One row per coin that a title lists, with kind `futures` or `spot`; a title that names both ways of trading is of futures."""
    t = F.col(title)
    kind = F.when(t.contains(NOT_A_LISTING), None).when(t.rlike(FUTURES_TITLE), "futures").when(t.contains(SPOT_TITLE), "spot")
    futures = F.filter(F.regexp_extract_all(t, F.lit(FUTURES_TICKER), F.lit(1)), lambda x: x != "USD")
    names = F.when(F.col("kind") == "futures", futures).otherwise(F.regexp_extract_all(t, F.lit(SPOT_TICKER), F.lit(1)))
    return df.withColumn("kind", kind).where("kind is not null").withColumn("ticker", F.explode(names))


def traded_as(coins: DataFrame, ticker: str, instruments: DataFrame, inst: str = "inst_id", suffix: str = "-USDT") -> DataFrame:
    """coins with the instrument a ticker trades as: the plain name first, then its multiples; null if there is none."""
    names = reduce(DataFrame.unionByName, [coins.select(ticker).distinct().select(ticker, F.lit(k).alias("_k"), F.concat(F.lit(m), F.col(ticker), F.lit(suffix)).alias(inst)) for k, m in enumerate(MULTIPLES)])
    best = names.join(instruments.select(inst).distinct(), inst).groupBy(ticker).agg(F.min_by(inst, "_k").alias(inst))
    return coins.join(best, ticker, "left")


def screen(instruments: DataFrame, tickers: DataFrame, leaders: DataFrame, least_volume: float, least_lead: float, most_tick_bps: float, least_tick_bps: float, least_ticks: float) -> DataFrame:
    """Every quoted instrument with its numbers and all reasons against it (an empty list: none).

    instruments (inst_id, tick, contract, state), tickers (inst_id, last, bid, ask, volume), leaders (symbol, lead_volume).
    An instrument without a ticker, or with prices that are no prices, isn't listed; one without a leader is.
    """
    both = (F.col("bid") > 0) & (F.col("ask") > 0)
    t = tickers.where(F.col("inst_id").endswith("-USDT") & (F.col("last") > 0)).join(instruments.where("tick > 0"), "inst_id")
    t = t.withColumn("symbol", F.replace("inst_id", F.lit("-"), F.lit(""))).join(leaders, "symbol", "left")
    mid = F.when(both, (F.col("bid") + F.col("ask")) / 2).otherwise(F.col("last"))
    spread = F.when(both, F.col("ask") - F.col("bid"))
    t = t.withColumns({"price": F.col("last"), "tick_bps": F.col("tick") / F.col("last") * 1e4, "spread_bps": spread / mid * 1e4, "spread_ticks": spread / F.col("tick"), "value": F.col("volume") * F.coalesce("contract", F.lit(1.0)) * F.col("last")})
    rules = {
        "not live": F.coalesce("state", F.lit("live")) == "live", "coarse tick": F.col("tick_bps") <= most_tick_bps, "fine tick": F.col("tick_bps") >= least_tick_bps, "narrow": F.col("spread_ticks") >= least_ticks,
        "thin": F.col("value") >= least_volume, "no leader": F.col("lead_volume").isNotNull(), "thin leader": F.coalesce(F.col("lead_volume") >= least_lead, F.lit(True)),
    }
    return t.select("inst_id", "price", "tick_bps", "spread_bps", "spread_ticks", "value", "lead_volume", M.reasons(rules).alias("reasons"))


def candle(text: str) -> dict[str, Column]:
    """ts and decimal prices of a candle in JSON, an object (`ts` or `time`, open, high, low, close) or a list in that order; a missing price is 0, one that is no number makes all null."""
    t = F.col(text)
    cell = lambda names, at: F.coalesce(*[F.get_json_object(t, f"$.{n}") for n in names], F.get_json_object(t, f"$[{at}]"))
    raw = {n: cell((n,), k) for k, n in enumerate(("open", "high", "low", "close"), 1)}
    price = {n: F.coalesce(F.when(v != "", v), F.lit("0")).try_cast("decimal(28,10)") for n, v in raw.items()}
    long_enough = F.coalesce(F.json_array_length(t) >= 5, F.lit(True))
    ts = cell(("ts", "time"), 0).try_cast("long")
    whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in price.values()], ts.isNotNull()) & long_enough
    return {n: F.when(whole, v) for n, v in ({"ts": ts} | price).items()}


def ticker_price(text: str) -> Column:
    """The first price above 0 among `last`, `lastPrice`, `markPrice` and `price` of a ticker in JSON."""
    each = [F.get_json_object(F.col(text), f"$.{n}").try_cast("decimal(28,10)") for n in ("last", "lastPrice", "markPrice", "price")]
    return F.coalesce(*[F.when(x > 0, x) for x in each])


def fee_schedule(spark: SparkSession, fees: dict[int, tuple[float, float]] = FEES) -> DataFrame:
    """(tier, maker_bps, taker_bps)."""
    return spark.createDataFrame([(t, float(m), float(k)) for t, (m, k) in fees.items()], "tier int, maker_bps double, taker_bps double")


def ladder_faults(fees: DataFrame) -> DataFrame:
    """Tiers whose rates are worse than those of the tier below, or the same: a schedule read wrong. One row a tier, so one task."""
    o = Window.orderBy("tier")
    m, t = F.lag("maker_bps").over(o), F.lag("taker_bps").over(o)
    worse = (F.col("maker_bps") > m) | (F.col("taker_bps") > t)
    same = (F.col("maker_bps") == m) & (F.col("taker_bps") == t)
    return fees.withColumn("fault", F.when(worse, "worse").when(same, "same")).where("fault is not null")


def with_funding(days: DataFrame, funding: DataFrame, on: list[str], rate: str = "funding", periods: str = "periods") -> DataFrame:
    """days with their funding; a day without any has a null rate and no periods."""
    return days.join(funding.select(*on, rate, periods), on, "left").fillna(0, [periods])


def time_order(df: DataFrame, key: str, arrival: str, at: str) -> DataFrame:
    """df with `place`, its place in time among its key's rows (of equal times the first to arrive comes first), and `late`, whether it came after a row of a later time."""
    came = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("late", F.coalesce(F.max(at).over(came) > F.col(at), F.lit(False))).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(at, arrival)))


def depth_state(anchors: DataFrame, depth: DataFrame, key: str, bands: tuple[str, ...], rows: int = 60) -> DataFrame:
    """anchors with the depth last seen: its age, the imbalance in each band, and the log of all depth over the median of the `rows` anchors before (0 for the first).

    depth has `neg_<band>` and `pos_<band>`; an anchor without a whole or positive depth is dropped.
    """
    sides = [f"{s}_{b}" for b in bands for s in ("neg", "pos")]
    j = joins.asof_backward(anchors, depth, key, sides, keep_unmatched=False).dropna(subset=[f"r_{s}" for s in sides])
    total = reduce(lambda a, b: a + b, [F.col(f"r_{s}") for s in sides])
    for b in bands:
        n, p = F.col(f"r_neg_{b}"), F.col(f"r_pos_{b}")
        j = j.withColumn(f"depth_imb_{b}", F.when(n + p > 0, (n - p) / (n + p)).otherwise(0.0))
    j = j.withColumn("_ln", F.log(total)).where(total > 0)
    before = Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(-rows, -1)
    j = j.withColumn("depth_age_s", (F.col("ts") - F.col("r_ts")) / 1000).withColumn("_b", F.array_sort(F.collect_list("_ln").over(before)))
    median = F.expr("(get(_b, cast((size(_b) - 1) div 2 as int)) + get(_b, cast(size(_b) div 2 as int))) / 2")
    j = j.withColumn("depth_total_ln", F.coalesce(F.col("_ln") - median, F.lit(0.0)))
    return j.select(*anchors.columns, "depth_age_s", *[f"depth_imb_{b}" for b in bands], "depth_total_ln")


def lead_trades(grid: DataFrame, key: str, leader, horizon: int, fee_bps: float, edge_bps: float) -> DataFrame:
    """Trades taken where the leader's mid is beyond a follower's touch by fee and edge, one at a time per follower, closed `horizon` later.

    grid: (key, ts, bid, ask) at common steps, without stale rows. Net of both fees, against the mid and against the touch at the exit;
    an entry whose exit row is missing isn't one.
    """
    mid = (F.col("bid") + F.col("ask")) / 2
    lead = grid.where(F.col(key) == leader).select("ts", mid.alias("_lead"))
    out = W.ordered(key).rangeBetween(horizon, horizon)
    f = grid.where(F.col(key) != leader).withColumns({"_bid": F.max("bid").over(out), "_ask": F.max("ask").over(out)}).join(lead, "ts")
    beyond = (fee_bps + edge_bps) / 1e4
    side = F.when(F.col("_lead") > F.col("ask") * (1 + beyond), 1).when(F.col("_lead") < F.col("bid") * (1 - beyond), -1)
    f = f.withColumn("side", side).where("side is not null and _bid is not null")
    f = non_overlapping(f, key, horizon, strict=False)
    entry = F.when(F.col("side") > 0, F.col("ask")).otherwise(F.col("bid"))
    net = lambda x: ratio(F.col("side") * (x - entry), entry) * 1e4 - 2 * fee_bps
    return f.select(key, "ts", "side", entry.alias("entry"), net((F.col("_bid") + F.col("_ask")) / 2).alias("net_mid"), net(F.when(F.col("side") > 0, F.col("_bid")).otherwise(F.col("_ask"))).alias("net_touch"))


def aligned(df: DataFrame, at: str, anchor: int, hold: int) -> DataFrame:
    """Rows at or after the anchor, on its grid of `hold`: every venue then rebalances on the same days."""
    return df.where((F.col(at) >= anchor) & ((F.col(at) - anchor) % hold == 0))


def period_stack(books: dict[str, DataFrame], at: str, net: str) -> DataFrame:
    """The periods that every venue has: at, one column a venue, and `stack`, their mean."""
    each = [b.select(at, F.col(net).alias(n)) for n, b in books.items()]
    j = reduce(lambda a, b: a.join(b, at), each)
    return j.dropna().withColumn("stack", reduce(lambda a, b: a + b, [F.col(n) for n in books]) / len(books))


def stack_summary(stack: DataFrame, names: list[str], per_year: float) -> DataFrame:
    """Per venue and for the stack: periods, mean, Sharpe ratio, deviation, worst period, and the correlation with the stack."""
    long = stack.select("stack", F.explode(F.array(*[F.struct(F.lit(n).alias("book"), F.col(n).alias("x")) for n in [*names, "stack"]])).alias("p")).select("stack", "p.book", "p.x")
    sd = F.stddev_samp("x")
    return long.groupBy("book").agg(F.count(F.lit(1)).alias("periods"), F.avg("x").alias("mean"), F.when(sd > 0, F.avg("x") / sd * math.sqrt(per_year)).alias("sharpe"), sd.alias("sd"), F.min("x").alias("worst"), corr("x", "stack").alias("with_stack"))


def premium_factors(df: DataFrame, key: str, at: str, premium: str, short: int, long: int) -> DataFrame:
    """df with prem_now, prem_short, prem_long and prem_chg: high where the premium is low, or lower than it was."""
    o = W.ordered(key, at)
    s, w = W.trailing_mean_covered(o, premium, short), W.trailing_mean_covered(o, premium, long)
    return df.withColumns({"prem_now": -F.col(premium), "prem_short": -s, "prem_long": -w, "prem_chg": -(s - w)})


def premium_tails(df: DataFrame, key: str, at: str, price: str, funding: str, signal: str, least: float, hold: int, cost: float) -> DataFrame:
    """Buying where the signal is beyond `least` on either side, one hold at a time per name: events, names, net excess over the market, its error by periods, funding paid, share gained."""
    o = W.ordered(key, at)
    later = F.when(F.lead(at, hold).over(o) == F.col(at) + hold, F.log(F.lead(price, hold).over(o) / F.col(price)) * 1e4)
    paid = F.coalesce(F.sum(funding).over(o.rowsBetween(1, hold)), F.lit(0.0))
    d = df.withColumn("_fwd", later).withColumn("_paid", paid)
    d = d.withColumn("_ex", F.col("_fwd") - F.avg("_fwd").over(Window.partitionBy(at))).where("_ex is not null")

    def one(tail: str, hit: Column) -> DataFrame:
        e = non_overlapping(d.where(hit), key, hold, at=at).withColumn("tail", F.lit(tail)).withColumn("net", F.col("_ex") - F.col("_paid") - 2 * cost)
        per = e.groupBy("tail", F.floor(F.col(at) / hold).alias("_p")).agg(F.avg("net").alias("_m")).groupBy("tail").agg((F.stddev_samp("_m") / F.sqrt(F.count(F.lit(1)))).alias("se"))
        return e.groupBy("tail").agg(F.count(F.lit(1)).alias("events"), F.countDistinct(key).alias("names"), F.avg("net").alias("net"), F.avg("_paid").alias("paid"), F.avg((F.col("net") > 0).cast("double")).alias("gained")).join(per, "tail")

    return one("above", F.col(signal) > least).unionByName(one("below", F.col(signal) < -least))


def aligned_scores(rows: DataFrame, predictions: DataFrame, key: str, at: str, target: str) -> DataFrame:
    """Per name, rows and the correlation of another runtime's predictions with the target; refused if the two aren't the same rows.

    A prediction one row off scores like a signal, so both sides' rows without a partner, and repeated ones, are counted first.
    """
    a = rows.groupBy(key, at).agg(F.count(F.lit(1)).alias("_n"), F.first(target).alias("_y"))
    b = predictions.groupBy(key, at).agg(F.count(F.lit(1)).alias("_m"), F.first("prediction").alias("_x"))
    j = a.join(b, [key, at], "full")
    out = j.where("coalesce(_n, 0) <> 1 or coalesce(_m, 0) <> 1").groupBy(key).count().orderBy(key).limit(20).collect()
    if out:
        raise ValueError("predictions out of step: " + ", ".join(f"{r[0]} ({r[1]} rows)" for r in out))
    return j.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), corr("_x", "_y").alias("ic"))


def ou_bars(spark: SparkSession, days: int, half_life_hours: float | None, daily_vol: float = 0.03, seed: int = 1, sub_steps: int = 60, start_ms: int = 1_700_000_000_000) -> DataFrame:
    """(ts, open, high, low, close) a minute of a made-up mean-reverting log price, or of a random walk without a half-life.

    A step is a normal draw from an MD5, so partitions don't change it. Each hour is summed by itself; the hours' starting levels
    come from one fold over a number an hour. Bars hold the real extremes of `sub_steps` steps.
    """
    per, dt = 60 * sub_steps, 1 / (1440 * sub_steps)
    decay = 1.0 if half_life_hours is None else 1 - math.log(2) / (half_life_hours / 24) * dt
    if decay**per < 1e-200:
        raise ValueError("the half-life is too short for an hour's sum")
    i = spark.range(days * 24 * per).select("id", F.expr(f"id div {per}").alias("hour"), (F.col("id") % per).alias("j"), digest(F.lit(seed), "id").alias("_d"))
    u = lambda at: (F.conv(F.substring("_d", at, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    shock = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(9)) * daily_vol * math.sqrt(dt)
    far = F.pow(F.lit(decay), F.col("j").cast("double"))
    so_far = Window.partitionBy("hour").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    x = i.withColumn("_x", F.sum(shock / far).over(so_far) * far)
    ends = x.where(F.col("j") == per - 1).agg(F.array_sort(F.collect_list(F.struct("hour", "_x"))).alias("_e"))
    zero = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("all"))
    levels = F.aggregate("_e", zero, lambda a, e: F.struct((a["at"] * decay**per + e["_x"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    levels = ends.select(F.posexplode(levels).alias("hour", "_from")).withColumn("hour", F.col("hour").cast("long"))
    p = x.join(levels, "hour").withColumn("price", 100 * F.exp(F.col("_x") + F.col("_from") * far * decay))
    b = p.groupBy(F.expr(f"id div {sub_steps}").alias("minute")).agg(F.min_by("price", "id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "id").alias("close"))
    return b.select((start_ms + F.col("minute") * 60_000).alias("ts"), "open", "high", "low", "close")

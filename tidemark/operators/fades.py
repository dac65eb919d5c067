"""Fading a range at its edges: every entry's bracketed exit worked out by itself, then the chain of trades one position can take; grids of settings and a control."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions.draws import digest, drawn
from tidemark.functions.ieee import ln, ratio
from tidemark.operators import windows as W


@dataclass(frozen=True)
class Fade:
    """A setting: the range is of `look` bars before; entry, stop and target are shares of its width from the edge that is faded."""

    name: str
    look: int
    hold: int
    entry: float = 0.1
    stop: float = 0.1
    target: float = 0.5
    least_width_bps: float = 0.0
    most_trend: float | None = None


@dataclass(frozen=True)
class Costs:
    """In bps. A resting order counts as filled `through` beyond its price (not if optimistic); exits by the taker slip."""

    maker: float = 2.0
    taker: float = 6.0
    slip: float = 0.0
    through: float = 0.0


def chained(events: DataFrame, by: list[str], at: str, until: str, longest: int) -> DataFrame:
    """Events taken greedily in order of `at`: one is kept if it comes after the `until` of the last one kept.

    No event lasts more than `longest`, so after a longer pause the chain starts anew: each stretch without such a pause
    is folded by itself, on the JVM side. `at` and `until` are longs, `at` is unique within `by`.
    """
    o = Window.partitionBy(*by).orderBy(at)
    fresh = F.coalesce(F.col(at) - F.lag(at).over(o) > longest, F.lit(True)).cast("int")
    t = events.select(*by, at, until).withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    alone = t.groupBy(*by, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), F.col(until).alias("u")))).alias("_e"))
    start = F.struct(F.lit(None).cast("long").alias("u"), F.array().cast("array<long>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        take = acc["u"].isNull() | (e["a"] > acc["u"])
        return F.struct(F.when(take, e["u"]).otherwise(acc["u"]).alias("u"), F.when(take, F.concat(acc["kept"], F.array(e["a"]))).otherwise(acc["kept"]).alias("kept"))

    kept = alone.select(*by, F.explode(F.aggregate("_e", start, step, lambda a: a["kept"])).alias(at))
    return events.join(kept, [*by, at], "left_semi")


def _numbered(bars: DataFrame, key: str) -> DataFrame:
    return bars.select(key, "ts", "open", "high", "low", "close", F.row_number().over(W.ordered(key)).cast("long").alias("_i"))


def candidates(bars: DataFrame, key: str, runs: list[Fade], costs: Costs, optimistic: bool, step: int | None = None, allow: str | None = None) -> DataFrame:
    """Bars that would fill an entry, per run: (key, run, _i, ts, side, fill, stop, target, hold); side 0 where both would be.

    An order only rests if the bar opens on its far side. With `step`, ranges over a hole in the bars aren't ranges.
    """
    o = W.ordered(key)
    gate = [F.col(allow).alias("_allow")] if allow else []
    b = bars.select(key, "ts", "open", "high", "low", "close", F.row_number().over(o).cast("long").alias("_i"), *gate)
    for n in sorted({r.look for r in runs}):
        hi, lo = W.trailing_extremes(o, "high", "low", n)
        whole = F.lit(True) if step is None else W.contiguous_back(o, "ts", step, n)
        b = b.withColumns({f"_hi{n}": F.when(whole, hi), f"_lo{n}": F.when(whole, lo), f"_tr{n}": F.abs(F.lag("close", 1).over(o) - F.lag("close", n).over(o))})
    setting = lambda r: F.struct(F.lit(r.name).alias("run"), F.lit(r.hold).cast("long").alias("hold"), *[F.lit(float(getattr(r, x))).alias(x) for x in ("entry", "stop", "target", "least_width_bps")], F.lit(r.most_trend).cast("double").alias("most"), F.col(f"_hi{r.look}").alias("hi"), F.col(f"_lo{r.look}").alias("lo"), F.col(f"_tr{r.look}").alias("trend"))
    c = b.select(key, "ts", "_i", "open", "high", "low", *(["_allow"] if allow else []), F.explode(F.array(*[setting(r) for r in runs])).alias("r")).select("*", "r.*").drop("r")
    c = c.where("hi > lo").withColumn("w", F.col("hi") - F.col("lo"))
    ok = (F.col("w") / ((F.col("hi") + F.col("lo")) / 2) * 1e4 >= F.col("least_width_bps")) & (F.col("most").isNull() | (F.col("trend") / F.col("w") <= F.col("most")))
    c = c.where(ok & F.col("_allow") if allow else ok)
    past = 0.0 if optimistic else costs.through / 1e4
    # A step for each level, so that none is worked out again wherever it is used.
    c = c.withColumns({"buy": F.col("lo") + F.col("entry") * F.col("w"), "sell": F.col("hi") - F.col("entry") * F.col("w")})
    c = c.withColumns({"up": (F.col("open") > F.col("buy")) & (F.col("low") <= F.col("buy") * (1 - past)), "down": (F.col("open") < F.col("sell")) & (F.col("high") >= F.col("sell") * (1 + past))}).where("up or down")
    c = c.withColumn("side", F.when(F.col("up") & F.col("down"), 0).when(F.col("up"), 1).otherwise(-1))
    edge = F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi"))
    return c.select(key, "run", "_i", "ts", "side", F.when(F.col("up"), F.col("buy")).otherwise(F.col("sell")).alias("fill"), (edge - F.col("side") * F.col("stop") * F.col("w")).alias("stop"), (edge + F.col("side") * F.col("target") * F.col("w")).alias("target"), "hold")


def fade_trades(bars: DataFrame, key: str, runs: list[Fade], costs: Costs = Costs(), optimistic: bool = False, leverage: float | None = None, mmr: float = 0.005, buffer: float = 0.0, step: int | None = None, allow: str | None = None) -> DataFrame:  # noqa: B008
    """Trades of one position at a time per key and run: levels freeze at the entry, exits are bracketed, the last resort is a time stop.

    Bars that fill both entries are skipped; so are, with `leverage`, stops beyond the liquidation. Exits by priority: a gap past the
    stop, a gap past the target, the target (if optimistic, or no stop in the bar), the stop; else the close after `hold` bars, or
    `open` where the bars end before. The fill's own bar has no gaps, and its target counts only if optimistic. Targets pay the maker,
    all else the taker and slips; a stop that fills beyond the liquidation loses the margin instead. `allow` gates entries, not exits.

    Each entry meets the bars of its hold in an equi-join on buckets of bars; only the chain of trades is sequential.
    """
    longest = max(r.hold for r in runs)
    liquid = M.liquidation_price("side", "fill", leverage, mmr, buffer) if leverage else F.lit(None).cast("double")
    c = candidates(bars, key, runs, costs, optimistic, step, allow).where("side <> 0").withColumn("liq", liquid)
    c = c.where("liq is null or side * (stop - liq) > 0")
    size = longest + 1
    c = c.withColumn("_k", F.explode(F.sequence(F.expr(f"_i div {size}"), F.expr(f"(_i + hold) div {size}"))))
    b = _numbered(bars, key).select(F.col(key).alias("_key"), F.expr(f"_i div {size}").alias("_kb"), F.col("_i").alias("_j"), F.col("ts").alias("_ts"), *[F.col(x).alias(f"_{x[0]}") for x in ("open", "high", "low", "close")])
    j = c.join(b, c[key].eqNullSafe(F.col("_key")) & (F.col("_k") == F.col("_kb")) & (F.col("_j") >= F.col("_i")) & (F.col("_j") <= F.col("_i") + F.col("hold")))

    past = 0.0 if optimistic else costs.through / 1e4
    signed = lambda x, level: F.col("side") * (x - level)
    j = j.withColumns({"later": F.col("_j") > F.col("_i"), "worst": F.when(F.col("side") > 0, F.col("_l")).otherwise(F.col("_h")), "best": F.when(F.col("side") > 0, F.col("_h")).otherwise(F.col("_l"))})
    j = j.withColumns({"stopped": signed(F.col("worst"), F.col("stop")) <= 0, "far": F.col("target") * (1 + F.when(F.col("later"), F.col("side") * past).otherwise(0.0))})
    reached = (signed(F.col("best"), F.col("far")) >= 0) & (F.lit(optimistic) | (F.col("later") & ~F.col("stopped")))
    gap_stop, gap_target = (F.col("later") & (signed(F.col("_o"), F.col("stop")) <= 0)), (F.col("later") & (signed(F.col("_o"), F.col("target")) >= 0))
    j = j.withColumn("code", F.when(gap_stop, "gap_stop").when(gap_target, "gap_target").when(reached, "target").when(F.col("stopped"), "stop"))
    code = F.col("code")
    price = F.when(code.isin("gap_stop", "gap_target"), F.col("_o")).when(code == "target", F.col("target")).otherwise(F.col("stop"))
    head = [key, "run", "_i", "ts", "side", "fill", "hold", "liq"]
    e = j.groupBy(*head).agg(F.min(F.when(code.isNotNull(), F.struct("_j", F.col("_ts").alias("ts"), price.alias("price"), code.alias("why")))).alias("hit"), F.max(F.struct("_j", F.col("_ts").alias("ts"), F.col("_c").alias("price"))).alias("end"))
    timed = F.when(F.col("end._j") == F.col("_i") + F.col("hold"), "time").otherwise("open")
    e = e.select(*head, F.coalesce("hit._j", "end._j").alias("_x"), F.coalesce("hit.ts", "end.ts").alias("exit_ts"), F.coalesce("hit.price", "end.price").alias("level"), F.coalesce("hit.why", timed).alias("reason"))
    e = chained(e, [key, "run"], "_i", "_x", longest)

    e = e.withColumn("made", F.col("reason").isin("target", "gap_target")).withColumn("leave", F.col("level") * (1 - F.when(F.col("made"), 0.0).otherwise(F.col("side") * costs.slip / 1e4)))
    e = e.withColumn("gone", F.coalesce(F.col("reason").isin("stop", "gap_stop") & (F.col("side") * (F.col("liq") - F.col("leave")) >= 0), F.lit(False)))
    made, leave, gone = F.col("made"), F.col("leave"), F.col("gone")
    fees = costs.maker + F.when(gone, 0.0).when(made, costs.maker).otherwise(costs.taker)
    margin = F.lit(-1e4 / leverage if leverage else None).cast("double")
    net = F.when(gone, margin).otherwise(F.col("side") * (leave / F.col("fill") - 1) * 1e4) - fees
    return e.select(key, "run", F.col("ts").alias("entry_ts"), "exit_ts", "side", F.col("fill").alias("entry"), F.when(gone, F.col("liq")).otherwise(leave).alias("exit"), F.when(gone, "liquidated").otherwise(F.col("reason")).alias("reason"), net.alias("net_bps"), fees.alias("fees_bps"))


def segments(trades: DataFrame, split_ts: int, recent_ts: int) -> DataFrame:
    """trades once per segment they lie wholly in: `before` and `after` the split, and `recent`; one across the split is in neither."""
    inside = {"before": F.col("exit_ts") < split_ts, "after": F.col("entry_ts") >= split_ts, "recent": F.col("entry_ts") >= recent_ts}
    return trades.withColumn("segment", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in inside.items()]))))


def fade_report(trades: DataFrame, by: list[str], day_ms: int = 86_400_000) -> DataFrame:
    """Per group: trades, days, mean net, share and mean of wins and losses, shares of exits by the taker and by liquidation, mean fees."""
    won = F.col("net_bps") > 0
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.countDistinct(F.floor(F.col("entry_ts") / day_ms)).alias("days"), F.avg("net_bps").alias("mean_net"), share(won).alias("won"), F.avg(F.when(won, F.col("net_bps"))).alias("mean_win"), F.avg(F.when(~won, F.col("net_bps"))).alias("mean_loss"),
        share(~F.col("reason").isin("target", "gap_target", "liquidated")).alias("by_taker"), share(F.col("reason") == "liquidated").alias("liquidated"), F.avg("fees_bps").alias("mean_fees"),
    )


def shuffled_bars(bars: DataFrame, key: str, seed: int) -> DataFrame:
    """Bars whose shapes (open, high, low and close against the close before) are dealt anew inside each day: the same moves without their order.

    A key's first bar is measured against its own open, where the new path starts as well.
    """
    o = W.ordered(key)
    shape = ("open", "high", "low", "close")
    m = bars.select(key, "ts", F.expr("(ts - 1) div 86400000").alias("_day"), F.first("open").over(o).alias("_at"), *[ln(ratio(x, F.coalesce(F.lag("close").over(o), F.col("open")))).alias(f"_{x}") for x in shape])
    d = Window.partitionBy(key, "_day")
    m = m.withColumn("_i", F.row_number().over(d.orderBy("ts"))).withColumn("_j", F.row_number().over(d.orderBy(digest(F.lit(seed), key, "ts"), "ts")))
    dealt = m.select(key, "_day", "ts", "_at", "_i").join(m.select(key, "_day", F.col("_j").alias("_i"), *[f"_{x}" for x in shape]), [key, "_day", "_i"])
    before = F.sum("_close").over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_close")
    p = dealt.withColumn("_before", before)
    return p.select(key, "ts", *[(F.col("_at") * F.exp(F.col("_before") + F.col(f"_{x}"))).alias(x) for x in shape])


def day_sums(trades: DataFrame, by: list[str], day_ms: int = 86_400_000) -> DataFrame:
    """(by, day, total, n) of the trades entered on each day."""
    return trades.groupBy(*by, F.floor(F.col("entry_ts") / day_ms).alias("day")).agg(F.sum("net_bps").alias("total"), F.count(F.lit(1)).alias("n"))


def _redrawn(days: DataFrame, by: list[str], draws: int, seed: int, sums: list[str]) -> DataFrame:
    """Sums over as many days as a group has, drawn with replacement, per group and draw; groups of one day give none."""
    over = Window.partitionBy(*by)
    d = days.withColumns({"_i": F.row_number().over(over.orderBy("day")) - 1, "_n": F.count(F.lit(1)).over(over)}).where("_n > 1")
    picks = d.select(*by, F.col("_i").alias("_p"), "_n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.select(*by, "draw", drawn(F.col("_n"), F.lit(seed), "draw", "_p").cast("int").alias("_i"))
    return picks.join(d, [*by, "_i"]).groupBy(*by, "draw").agg(*[F.sum(x).alias(x) for x in sums])


def _interval(values: DataFrame, by: list[str], value: Column) -> DataFrame:
    return values.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def mean_interval(trades: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """Mean net per group, and where 95 % of its means lie when whole days are drawn anew; no interval for a single day."""
    days = day_sums(trades, by)
    mean = days.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("mean"))
    return mean.join(_interval(_redrawn(days, by, draws, seed, ["total", "n"]), by, F.col("total") / F.col("n")), by, "left")


def difference_interval(a: DataFrame, b: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """Mean net of a less that of b per group that both have, with an interval from drawing the same days in both.

    A draw without trades on one side gives no difference.
    """
    x, y = day_sums(a, by), day_sums(b, by).withColumnsRenamed({"total": "_bt", "n": "_bn"})
    days = x.join(y, [*by, "day"], "full").fillna(0).fillna(0.0)
    sums = ["total", "n", "_bt", "_bn"]
    gap = F.col("total") / F.col("n") - F.col("_bt") / F.col("_bn")
    point = days.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums]).where("n > 0 and _bn > 0").select(*by, gap.alias("difference"))
    return point.join(_interval(_redrawn(days, by, draws, seed, sums).where("n > 0 and _bn > 0"), by, gap), by, "left")

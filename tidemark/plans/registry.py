"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.operators import cross_section as X
from tidemark.operators import folds, joins, sequential
from tidemark.operators import statistics as S
from tidemark.operators import windows as W
from tidemark.sources import views as V
from tidemark.sources.views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "factor_run_carry_mom"
HOUR, DAY = 3_600_000, 86_400_000


def query(name: str, oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that the order of summation doesn't show."""
    return df.select(*[V.rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Folds -------------------------------------------------------------------------------------------------------------
@query("bars_hourly", sql("SELECT symbol, ts, open, high, low, close, round(volume, 6) AS volume, round(taker, 6) AS taker, n FROM bars", "bars"))
def bars_hourly(s, d):
    return r6(V.bars(s, d))


@query("bars_daily", sql("""
, st AS (SELECT *, ((ts - 1) // 86400000 + 1) * 86400000 AS day, ln(close / lag(close) OVER (PARTITION BY symbol, (ts - 1) // 86400000 ORDER BY ts)) AS step FROM bars)
SELECT symbol, day AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, round(sum(volume), 6) AS volume,
       round(sum(taker) / sum(volume), 6) AS taker_frac, count(*) AS bars, round(sqrt(coalesce(sum(step * step), 0)) * 1e4, 6) AS rv_bps FROM st GROUP BY 1, 2""", "bars"))  # fmt: skip
def bars_daily(s, d):
    return r6(folds.fold_bars(V.bars(s, d), "symbol", DAY))


@query("funding_by_day", sql("SELECT symbol, (((ts + 30000) // 60000) * 60000 - 1) // 86400000 AS day, round(sum(bps), 6) AS bps, count(*) AS periods FROM funding GROUP BY 1, 2", "funding"))
def funding_by_day(s, d):
    return r6(folds.daily_funding(V.funding(s, d), "symbol"))


@query("funding_by_bar", sql("SELECT symbol, ((ts - 1) // 28800000 + 1) * 28800000 AS ts, round(sum(bps), 6) AS funding_bps, count(*) AS periods FROM funding GROUP BY 1, 2", "funding"))
def funding_by_bar(s, d):
    return r6(folds.settlements_by_bar(V.funding(s, d), "symbol", 8 * HOUR))


# Joins -------------------------------------------------------------------------------------------------------------
@query("asof_backward", sql("""
, q AS (SELECT inst, ts, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask FROM touches GROUP BY 1, 2)
SELECT t.inst, t.ts, t.seq, t.price, q.ts AS r_ts, q.bid AS r_bid, round(q.ask, 6) AS r_ask FROM trades t ASOF LEFT JOIN q ON t.inst = q.inst AND t.ts >= q.ts""", "touches", "trades"))  # fmt: skip
def asof_backward(s, d):
    return r6(joins.asof_backward(V.trades(s, d).select("inst", "ts", "seq", "price"), V.touches(s, d), "inst", ["bid", "ask"]))


@query("asof_lagged", sql("""
, q AS (SELECT inst, ts, arg_max(bid, seq) AS bid FROM touches GROUP BY 1, 2), l AS (SELECT *, ts - 300000 AS at FROM trades)
SELECT t.inst, t.ts, t.seq, q.ts AS r_ts, q.bid AS r_bid FROM l t ASOF JOIN q ON t.inst = q.inst AND t.at >= q.ts""", "touches", "trades"))  # fmt: skip
def asof_lagged(s, d):
    return joins.asof_backward(V.trades(s, d).select("inst", "ts", "seq"), V.touches(s, d), "inst", ["bid"], lag_ms=300_000, keep_unmatched=False)


@query("asof_clamped", sql("""
, q AS (SELECT inst, ts, arg_max(bid, seq) AS bid FROM touches GROUP BY 1, 2), f AS (SELECT inst, arg_min(bid, (ts, seq)) AS b0 FROM touches GROUP BY 1)
SELECT t.inst, t.ts, t.seq, coalesce(q.bid, f.b0) AS r_bid FROM trades t ASOF LEFT JOIN q ON t.inst = q.inst AND t.ts >= q.ts LEFT JOIN f ON t.inst = f.inst""", "touches", "trades"))  # fmt: skip
def asof_clamped(s, d):
    return joins.asof_backward(V.trades(s, d).select("inst", "ts", "seq"), V.touches(s, d), "inst", ["bid"], clamp_first=True).drop("r_ts")


@query("asof_forward", sql("""
, q AS (SELECT inst, ts, arg_min(bid, seq) AS bid FROM touches GROUP BY 1, 2), l AS (SELECT *, ts + 60000 AS at FROM trades)
SELECT t.inst, t.ts, t.seq, CASE WHEN q.ts <= t.at + 900000 THEN q.ts END AS r_ts, CASE WHEN q.ts <= t.at + 900000 THEN q.bid END AS r_bid
FROM l t ASOF LEFT JOIN q ON t.inst = q.inst AND t.at <= q.ts""", "touches", "trades"))  # fmt: skip
def asof_forward(s, d):
    return joins.asof_forward(V.trades(s, d).select("inst", "ts", "seq"), V.touches(s, d), "inst", ["bid"], ahead_ms=60_000, tolerance_ms=900_000)


@query("range_join_window", sql("""
SELECT t.inst, q.ts AS i_ts, q.seq AS i_seq, count(*) AS n, round(sum(t.size), 6) AS size FROM touches q JOIN trades t ON t.inst = q.inst AND t.ts > q.ts AND t.ts <= q.ts + 3600000 GROUP BY 1, 2, 3""", "touches", "trades"))  # fmt: skip
def range_join_window(s, d):
    m = joins.interval_join(V.trades(s, d), V.touches(s, d).select("inst", "ts", "seq"), "inst", HOUR, HOUR)
    return r6(m.groupBy("inst", "i_ts", "i_seq").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))


@query("passive_fills", sql("""
, q AS (SELECT seq AS q_id, inst, ts, 'bid' AS side, bid AS price, bid_sz AS queue FROM touches UNION ALL SELECT -seq, inst, ts, 'ask', ask, ask_sz FROM touches),
m AS (SELECT q.q_id, t.ts AS t_ts, q.queue, sum(t.size) OVER (PARTITION BY q.q_id ORDER BY t.ts, t.seq) AS run
      FROM q JOIN trades t ON t.inst = q.inst AND t.ts > q.ts AND t.ts <= q.ts + 7200000
      AND CASE WHEN side = 'bid' THEN NOT t.is_buy AND t.price <= q.price * (1 + 1e-9) ELSE t.is_buy AND t.price >= q.price * (1 - 1e-9) END),
f AS (SELECT q_id, min(t_ts) AS fill_ts FROM m WHERE run > queue GROUP BY 1)
SELECT q.q_id, q.inst, q.ts, q.side, f.fill_ts FROM q LEFT JOIN f USING (q_id)""", "touches", "trades"))  # fmt: skip
def passive_fills(s, d):
    q = V.touches(s, d)
    bid = q.select(F.col("seq").alias("q_id"), "inst", "ts", F.lit("bid").alias("side"), F.col("bid").alias("price"), F.col("bid_sz").alias("queue"))
    ask = q.select((-F.col("seq")).alias("q_id"), "inst", "ts", F.lit("ask").alias("side"), F.col("ask").alias("price"), F.col("ask_sz").alias("queue"))
    return sequential.queue_fills(bid.unionByName(ask), V.trades(s, d), "inst", 2 * HOUR, 1.0).select("q_id", "inst", "ts", "side", "fill_ts")


@query("band_join", sql("""
SELECT l_orderkey, l_linenumber, l_quantity AS size, coalesce((SELECT arg_min(mmr, max_size) FROM tiers WHERE l_quantity <= max_size), (SELECT arg_max(mmr, max_size) FROM tiers)) AS mmr FROM lineitem""", "tiers"))  # fmt: skip
def band_join(s, d):
    li = V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"))
    return joins.band_join(li, V.tiers(s, d), "size", "min_size", "max_size", ["mmr"])


@query("scaffold", sql("""
, e AS (SELECT min(ts) AS a, max(ts) AS b FROM bars), g AS (SELECT symbol, unnest(range(a, b + 1, 3600000)) AS ts FROM (SELECT DISTINCT symbol FROM bars), e)
SELECT g.symbol, g.ts, bars.close, last_value(bars.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS filled FROM g LEFT JOIN bars USING (symbol, ts)""", "bars"))  # fmt: skip
def scaffold(s, d):
    g = joins.scaffold(V.bars(s, d).select("symbol", "ts", "close"), "symbol", "ts", HOUR)
    return g.withColumn("filled", W.forward_fill(W.ordered("symbol"), "close")).select("symbol", "ts", "close", "filled")


@query("bucket_join", sql("""
, a AS (SELECT inst, ts // 3600000 AS bucket, arg_max(price, (ts, seq)) AS p FROM trades GROUP BY 1, 2), b AS (SELECT inst, ts // 3600000 AS bucket, arg_max(bid, (ts, seq)) AS q FROM touches GROUP BY 1, 2)
SELECT inst, bucket, a.p AS trade, b.q AS touch FROM a JOIN b USING (inst, bucket)""", "touches", "trades"))  # fmt: skip
def bucket_join(s, d):
    t, q = V.trades(s, d), V.touches(s, d).withColumn("price", F.col("bid"))
    return joins.bucket_join({"trade": t, "touch": q}, "inst", HOUR, "price")


@query("book_deltas", sql("""
, m AS (SELECT max(t) AS t FROM panel), a AS (SELECT symbol, funding AS v FROM panel, m WHERE panel.t = m.t - 1 AND funding > 0), b AS (SELECT symbol, funding AS v FROM panel, m WHERE panel.t = m.t AND funding > 0)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.v, 0) AS "current", coalesce(b.v, 0) AS target, round(coalesce(b.v, 0) - coalesce(a.v, 0), 6) AS delta,
       CASE WHEN a.v IS NULL THEN 'open' WHEN b.v IS NULL THEN 'close' ELSE 'resize' END AS action
FROM a FULL JOIN b ON a.symbol = b.symbol WHERE abs(coalesce(b.v, 0) - coalesce(a.v, 0)) > 1e-12""", "panel"))  # fmt: skip
def book_deltas(s, d):
    p = V.panel(s, d).where("funding > 0").join(F.broadcast(V.panel(s, d).agg(F.max("t").alias("m"))))
    return r6(joins.outer_deltas(p.where("t = m - 1"), p.where("t = m"), "symbol", "funding"))


@query("placebo_offset", sql("SELECT a.symbol, a.t, a.close, b.close AS o_close FROM panel a LEFT JOIN panel b ON a.symbol = b.symbol AND b.t = a.t + 3", "panel"))
def placebo_offset(s, d):
    return joins.offset_join(V.panel(s, d).select("symbol", "t", "close"), "symbol", "t", 3, ["close"])


_RET = "r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) * 1e4 AS ret FROM panel)"


def _returns(s, d):
    return V.panel(s, d).withColumn("ret", W.log_return(W.ordered("symbol", "t"), "close", 1))


@query("pair_correlation", sql(f", {_RET} SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.ret, b.ret), 6) AS corr FROM r a JOIN r b ON a.t = b.t AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2", "panel"))
def pair_correlation(s, d):
    return r6(joins.pair_correlations(_returns(s, d), "symbol", "t", "ret"))


@query("correlation_clusters", sql(f""", {_RET}, x AS (SELECT symbol, t, ret - avg(ret) OVER (PARTITION BY t) AS x FROM r WHERE ret IS NOT NULL), o AS (SELECT symbol FROM x GROUP BY 1 HAVING count(*) >= 20),
c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.x, b.x) AS corr FROM x a JOIN x b ON a.t = b.t AND a.symbol < b.symbol WHERE a.symbol IN (FROM o) AND b.symbol IN (FROM o) GROUP BY 1, 2 HAVING count(*) >= 20),
l AS (SELECT a, b FROM c WHERE corr >= 0.3 UNION ALL SELECT b, a FROM c WHERE corr >= 0.3), g AS (SELECT DISTINCT symbol AS a, symbol AS b FROM panel UNION SELECT g.a, l.b FROM g JOIN l ON l.a = g.b)
SELECT a AS symbol, min(b) AS cluster FROM g GROUP BY 1""", "panel").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def correlation_clusters(s, d):
    # Suppliers' prices move alike far less than coins': 0.3 in place of the operator's 0.75 leaves some links.
    return sequential.correlated_groups(_returns(s, d), "symbol", "t", "ret", least=0.3)


# Windows -----------------------------------------------------------------------------------------------------------
@query("trailing_extremes", sql("""
SELECT symbol, ts, CASE WHEN count(*) OVER b = 5 THEN max(high) OVER b END AS hi, CASE WHEN count(*) OVER b = 5 THEN min(low) OVER b END AS lo,
       CASE WHEN count(*) OVER f = 5 THEN max(high) OVER f END AS fhi, CASE WHEN count(*) OVER f = 5 THEN min(low) OVER f END AS flo FROM bars
WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""", "bars"))  # fmt: skip
def trailing_extremes(s, d):
    o = W.ordered("symbol")
    hi, lo = W.trailing_extremes(o, "high", "low", 5)
    fhi, flo = W.forward_extremes(o, "high", "low", 5)
    return V.bars(s, d).select("symbol", "ts", hi.alias("hi"), lo.alias("lo"), fhi.alias("fhi"), flo.alias("flo"))


@query("trailing_means", sql("""
SELECT symbol, t, round(CASE WHEN count(*) OVER x = 6 THEN avg(close) OVER x END, 6) AS before6, round(CASE WHEN count(*) OVER i = 6 THEN sum(coalesce(funding, 0)) OVER i END, 6) AS sum6,
       round(CASE WHEN count(*) OVER i = 6 AND count(funding) OVER i >= 5 THEN sum(funding) OVER i END, 6) AS tolerant6, round(CASE WHEN count(*) OVER i = 6 THEN avg(funding) OVER i END, 6) AS mean6,
       round(CASE WHEN row_number() OVER o > 6 AND count(funding) OVER i >= 4.8 THEN avg(funding) OVER i END, 6) AS covered6, round(CASE WHEN row_number() OVER o > 6 AND count(funding) OVER i = 6 THEN stddev_pop(funding) OVER i END, 4) AS std6 FROM panel
WINDOW o AS (PARTITION BY symbol ORDER BY t), x AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), i AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", "panel"))  # fmt: skip
def trailing_means(s, d):
    o = W.ordered("symbol", "t")
    out = V.panel(s, d).select("symbol", "t", W.trailing_mean_before(o, "close", 6).alias("before6"), W.trailing_sum(o, "funding", 6).alias("sum6"), W.trailing_sum_tolerant(o, "funding", 6).alias("tolerant6"), W.trailing_mean(o, "funding", 6).alias("mean6"), W.trailing_mean_covered(o, "funding", 6).alias("covered6"), F.round(W.trailing_std(o, "funding", 6), 4).alias("std6"))
    return r6(out)


@query("gap_aware_returns", sql("""
, g AS (SELECT *, lag(ts, 4) OVER o AS t4, lag(close, 4) OVER o AS c4, lead(ts, 4) OVER o AS f4, lead(close, 4) OVER o AS n4, CASE WHEN ts - lag(ts) OVER o <> 3600000 THEN 1 ELSE 0 END AS gap FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, (sum(gap) OVER (PARTITION BY symbol ORDER BY ts))::BIGINT AS breaks, coalesce(ts - t4 = 14400000, FALSE) AS back_ok, coalesce(f4 - ts = 14400000, FALSE) AS ahead_ok,
       round(CASE WHEN ts - t4 = 14400000 THEN ln(close / c4) * 1e4 END, 6) AS ret4, round(CASE WHEN f4 - ts = 14400000 THEN ln(n4 / close) * 1e4 END, 6) AS fwd4 FROM g""", "bars"))  # fmt: skip
def gap_aware_returns(s, d):
    o = W.ordered("symbol")
    b = W.break_count(V.bars(s, d), "symbol", "ts", HOUR)
    b = b.withColumn("back_ok", W.contiguous_back(o, "ts", HOUR, 4)).withColumn("ahead_ok", W.contiguous_forward(o, "ts", HOUR, 4))
    b = b.withColumn("ret4", F.when(F.col("back_ok"), W.log_return(o, "close", 4))).withColumn("fwd4", F.when(F.col("ahead_ok"), W.forward_log_return(o, "close", 4)))
    return r6(b.select("symbol", "ts", "breaks", "back_ok", "ahead_ok", "ret4", "fwd4"))


@query("bar_features", sql("""
SELECT symbol, ts, round(CASE WHEN count(*) OVER i = 12 THEN CASE WHEN max(high) OVER i > min(low) OVER i THEN (close - min(low) OVER i) / (max(high) OVER i - min(low) OVER i) ELSE 0.5 END END, 6) AS range_pos,
       round(ln(close / CASE WHEN count(*) OVER p = 13 THEN avg(close) OVER p END) * 1e4, 6) AS ma_dist, round(ln(high / low) / (2 * 0.8325546111576977) * 1e4, 6) AS parkinson,
       round(CASE WHEN sum(volume) OVER i > 0 THEN (2 * sum(taker) OVER i - sum(volume) OVER i) / sum(volume) OVER i ELSE 0 END, 6) AS tfi FROM bars
WINDOW i AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)""", "bars"))  # fmt: skip
def bar_features(s, d):
    o = W.ordered("symbol")
    i = o.rowsBetween(-11, 0)
    taker, volume = F.sum("taker").over(i), F.sum("volume").over(i)
    return r6(V.bars(s, d).select("symbol", "ts", W.range_position(o, "close", "high", "low", 12).alias("range_pos"), W.ma_distance(o, "close", 12).alias("ma_dist"), M.parkinson_bps("high", "low").alias("parkinson"), F.when(volume > 0, (2 * taker - volume) / volume).otherwise(0.0).alias("tfi")))


@query("microstructure", sql("""
, o AS (SELECT *, lag(bid) OVER w AS pb, lag(bid_sz) OVER w AS pbs, lag(ask) OVER w AS pa, lag(ask_sz) OVER w AS pas FROM touches WINDOW w AS (PARTITION BY inst ORDER BY ts, seq)),
f AS (SELECT *, coalesce(CASE WHEN bid > pb THEN bid_sz WHEN bid = pb THEN bid_sz - pbs ELSE -pbs END + CASE WHEN ask < pa THEN -ask_sz WHEN ask = pa THEN pas - ask_sz ELSE pas END, 0) AS ofi FROM o)
SELECT inst, ts, seq, round((bid + ask) / 2, 6) AS mid, round((bid * ask_sz + ask * bid_sz) / (bid_sz + ask_sz), 6) AS micro, round((bid_sz - ask_sz) / (bid_sz + ask_sz), 6) AS imb, ofi,
       round(sum(ofi) OVER (PARTITION BY inst ORDER BY ts RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW), 6) AS ofi_1h FROM f""", "touches"))  # fmt: skip
def microstructure(s, d):
    q = W.ofi(V.touches(s, d), "inst")
    return r6(q.select("inst", "ts", "seq", M.mid().alias("mid"), M.microprice().alias("micro"), M.imbalance("bid_sz", "ask_sz").alias("imb"), "ofi", W.time_sum("inst", HOUR, F.col("ofi")).alias("ofi_1h")))


@query("tape_sums", sql("""
SELECT inst, ts, seq, round(sum(CASE WHEN is_buy THEN size ELSE 0 END) OVER w, 6) AS buys, round(sum(CASE WHEN is_buy THEN 0 ELSE size END) OVER w, 6) AS sells, count(*) OVER w AS n,
       round(sum(price * size) OVER w / sum(size) OVER w, 6) AS vwap FROM trades WINDOW w AS (PARTITION BY inst ORDER BY ts RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)""", "trades"))  # fmt: skip
def tape_sums(s, d):
    t = lambda c: W.time_sum("inst", HOUR, c)
    buy, sell = F.when(F.col("is_buy"), F.col("size")).otherwise(0.0), F.when(F.col("is_buy"), 0.0).otherwise(F.col("size"))
    return r6(V.trades(s, d).select("inst", "ts", "seq", t(buy).alias("buys"), t(sell).alias("sells"), t(F.lit(1)).cast("long").alias("n"), (t(F.col("price") * F.col("size")) / t(F.col("size"))).alias("vwap")))


@query("swing_points", sql("""
SELECT symbol, ts, count(*) OVER w = 7 AND max(high) OVER w <= high AS top, count(*) OVER w = 7 AND min(low) OVER w >= low AS bottom FROM bars
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", "bars"))  # fmt: skip
def swing_points(s, d):
    top, bottom = W.swing_points(W.ordered("symbol"), "high", "low", 3)
    return V.bars(s, d).select("symbol", "ts", top.alias("top"), bottom.alias("bottom"))


@query("unbroken_runs", sql("""
, x AS (SELECT *, sum(CASE WHEN complete THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY t) AS off FROM panel)
SELECT symbol, t, complete, (sum(CASE WHEN complete THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, off ORDER BY t))::BIGINT AS run FROM x""", "panel"))  # fmt: skip
def unbroken_runs(s, d):
    return W.unbroken_run(V.panel(s, d), "symbol", "t", "complete").select("symbol", "t", "complete", "run")


@query("drawdowns", sql(f"""
, {_RET}, e AS (SELECT symbol, t, exp(sum(ln(1 + ret / 1e5)) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)) AS equity FROM r WHERE ret IS NOT NULL)
SELECT symbol, t, round(equity, 6) AS equity, round(equity / greatest(1, max(equity) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)) - 1, 6) AS dd FROM e""", "panel"))  # fmt: skip
def drawdowns(s, d):
    r = _returns(s, d).where("ret is not null").withColumn("x", F.col("ret") / 1e5)
    return r6(W.drawdown(r, "symbol", "t", "x").select("symbol", "t", "equity", "dd"))


# Cross-section -----------------------------------------------------------------------------------------------------
@query("cross_rank", sql("""
SELECT t, symbol, round(CASE WHEN count(*) OVER (PARTITION BY t) = 1 THEN 0 ELSE 2.0 * (row_number() OVER (PARTITION BY t ORDER BY funding, symbol) - 1) / (count(*) OVER (PARTITION BY t) - 1) - 1 END, 6) AS ordinal,
       rank() OVER (PARTITION BY t ORDER BY taker) + (count(*) OVER (PARTITION BY t, taker) - 1) / 2 AS average, round(funding - avg(funding) OVER (PARTITION BY t), 6) AS demeaned FROM panel""", "panel"))  # fmt: skip
def cross_rank(s, d):
    return r6(V.panel(s, d).select("t", "symbol", X.ordinal_rank("funding").alias("ordinal"), X.average_rank("taker", "t").alias("average"), X.demean("funding").alias("demeaned")))


_FACT = f"""{_RET}, f AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN -(sum(funding) OVER w) / 3 END AS carry, CASE WHEN lag(close, 3) OVER o IS NOT NULL THEN ln(close / lag(close, 3) OVER o) * 1e4 END AS mom FROM r
  WINDOW o AS (PARTITION BY symbol ORDER BY t), w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ok AS (SELECT t, symbol, row_number() OVER (PARTITION BY t ORDER BY rc, symbol) - 1 AS a, row_number() OVER (PARTITION BY t ORDER BY rm, symbol) - 1 AS b, count(*) OVER (PARTITION BY t) AS n FROM (SELECT *, round(carry, 6) AS rc, round(mom, 6) AS rm FROM f) WHERE rc IS NOT NULL AND rm IS NOT NULL),
s AS (SELECT f.t, f.symbol, f.close, f.funding, round(ok.a / greatest(n - 1, 1) * 0.6 + ok.b / greatest(n - 1, 1) * 0.4, 9) AS blend FROM f LEFT JOIN ok USING (t, symbol))"""


def _scored(s, d):
    o = W.ordered("symbol", "t")
    p = _returns(s, d).withColumn("carry", V.rounded(-W.trailing_sum(o, "funding", 3) / 3)).withColumn("mom", V.rounded(W.log_return(o, "close", 3)))
    return X.rank_blend(p, {"carry": 0.6, "mom": 0.4}).withColumn("blend", F.round("blend", 9))


@query("rank_blend", sql(f", {_FACT} SELECT t, symbol, round(blend, 6) AS blend FROM s", "panel"))
def rank_blend(s, d):
    return r6(_scored(s, d).select("t", "symbol", "blend"))


_BOOK = """b0 AS (SELECT t, symbol, row_number() OVER (PARTITION BY t ORDER BY blend, symbol) AS r, count(*) OVER (PARTITION BY t) AS n FROM s WHERE blend IS NOT NULL{more}),
b1 AS (SELECT *, CASE WHEN 2 * greatest(1, round_even(n * 0.3, 0)) > n THEN floor(n / 2) ELSE greatest(1, round_even(n * 0.3, 0)) END AS k FROM b0 WHERE n >= 6),
b AS (SELECT t, symbol, CASE WHEN r > n - k THEN 1.0::DOUBLE / k WHEN r <= k THEN -1.0::DOUBLE / k END AS weight FROM b1 WHERE r > n - k OR r <= k)"""


@query("long_short_book", sql(f", {_FACT}, {_BOOK.format(more='')} SELECT t, symbol, round(weight, 6) AS weight FROM b", "panel"))
def long_short_book(s, d):
    return r6(X.book(_scored(s, d), "blend"))


@query("book_turnover", sql(f"""
, {_FACT}, {_BOOK.format(more='')}
SELECT t, round(sum(abs(w)), 6) AS turnover FROM (SELECT coalesce(n.t, p.t + 1) AS t, coalesce(n.weight, 0) - coalesce(p.weight, 0) AS w FROM b n FULL JOIN b p ON n.symbol = p.symbol AND n.t = p.t + 1) WHERE t IN (SELECT t FROM b) GROUP BY 1""", "panel"))  # fmt: skip
def book_turnover(s, d):
    return r6(X.turnover(X.book(_scored(s, d), "blend"), 1))


@query("factor_run_carry_mom", sql(f"""
, {_FACT}, p AS (SELECT *, CASE WHEN lead(t, 3) OVER o = t + 3 THEN ln(lead(close, 3) OVER o / close) * 1e4 - sum(coalesce(funding, 0)) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) END AS fwd FROM s WINDOW o AS (PARTITION BY symbol ORDER BY t)),
{_BOOK.format(more=" AND (t - (SELECT min(t) FROM panel)) % 3 = 0")},
x AS (SELECT t, symbol, blend, fwd - avg(fwd) OVER (PARTITION BY t) AS x FROM p WHERE fwd IS NOT NULL AND blend IS NOT NULL AND (t - (SELECT min(t) FROM panel)) % 3 = 0),
w AS (SELECT b.t, b.symbol, weight / sum(abs(weight)) OVER (PARTITION BY b.t, sign(weight)) AS w, x FROM b JOIN x USING (t, symbol)),
g AS (SELECT t, sum(w * x) AS gross FROM w GROUP BY 1),
m AS (SELECT t, sum(abs(d)) AS turnover FROM (SELECT coalesce(n.t, q.t + 3) AS t, coalesce(n.w, 0) - coalesce(q.w, 0) AS d FROM w n FULL JOIN w q ON n.symbol = q.symbol AND n.t = q.t + 3) WHERE t IN (SELECT t FROM w) GROUP BY 1),
i AS (SELECT t, CASE WHEN count(*) >= 6 THEN corr(a, b) END AS ic FROM (SELECT t, rank() OVER (PARTITION BY t ORDER BY blend) + (count(*) OVER (PARTITION BY t, blend) - 1) / 2 AS a, rank() OVER (PARTITION BY t ORDER BY x) + (count(*) OVER (PARTITION BY t, x) - 1) / 2 AS b FROM x) GROUP BY 1)
SELECT t, round(gross / 2, 6) AS gross, round(turnover / 2, 6) AS turnover, round((gross - turnover * 10) / 2, 6) AS net, round(ic, 6) AS ic FROM g JOIN m USING (t) JOIN i USING (t)""", "panel"))  # fmt: skip
def factor_run_carry_mom(s, d):
    return r6(X.factor_run(_scored(s, d), "blend", 3))


# Statistics --------------------------------------------------------------------------------------------------------
_XY = f"{_RET}, xy AS (SELECT *, round(lead(ret) OVER (PARTITION BY symbol ORDER BY t), 6) AS y FROM r)"


def _xy(s, d):
    r = _returns(s, d)
    return r.withColumn("y", V.rounded(F.lead("ret").over(W.ordered("symbol", "t"))))


@query("cluster_mean", sql(f", {_RET}, c AS (SELECT symbol, t // 3 AS c, avg(ret) AS m, sum(ret) AS s, count(*) AS n FROM r WHERE ret IS NOT NULL GROUP BY 1, 2) SELECT symbol, sum(n)::BIGINT AS n, count(*) AS clusters, round(sum(s) / sum(n), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se FROM c GROUP BY 1", "panel"))
def cluster_mean(s, d):
    return r6(S.cluster_mean(_returns(s, d), ["symbol"], F.expr("t div 3"), "ret"))


@query("cluster_slope", sql(f"""
, {_XY}, c AS (SELECT symbol, t, funding - avg(funding) OVER (PARTITION BY symbol) AS x, y - avg(y) OVER (PARTITION BY symbol) AS y, t // 6 AS c FROM xy WHERE y IS NOT NULL),
f AS (SELECT symbol, sum(x * y) / sum(x * x) AS slope, sum(x * x) AS xx, count(*) AS n FROM c GROUP BY 1), p AS (SELECT symbol, c, sum(x * y) AS sxy, sum(x * x) AS sxx FROM c GROUP BY 1, 2)
SELECT symbol, round(any_value(slope), 6) AS slope, any_value(n) AS n, round(any_value(slope) / (sqrt(sum((sxy - slope * sxx) * (sxy - slope * sxx))) / any_value(xx)), 4) AS t_stat FROM p JOIN f USING (symbol) GROUP BY 1""", "panel"))  # fmt: skip
def cluster_slope(s, d):
    out = S.cluster_slope(_xy(s, d).withColumn("c", F.expr("t div 6")), ["symbol"], "c", "funding", "y")
    return out.select("symbol", V.rounded(F.col("slope")).alias("slope"), "n", F.round("t_stat", 4).alias("t_stat"))


@query("spearman_ic", sql(f"""
, {_XY}, k AS (SELECT t, rank() OVER (PARTITION BY t ORDER BY funding) + (count(*) OVER (PARTITION BY t, funding) - 1) / 2 AS a, rank() OVER (PARTITION BY t ORDER BY y) + (count(*) OVER (PARTITION BY t, y) - 1) / 2 AS b FROM xy WHERE y IS NOT NULL)
SELECT t, count(*) AS n, round(CASE WHEN count(*) < 3 OR stddev_pop(a) < 1e-12 OR stddev_pop(b) < 1e-12 THEN 0 ELSE corr(a, b) END, 6) AS spearman FROM k GROUP BY 1""", "panel"))  # fmt: skip
def spearman_ic(s, d):
    return r6(S.spearman(_xy(s, d), ["t"], "funding", "y"))


@query("auc_by_month", sql("""
, k AS (SELECT t, taker > 0.5 AS label, rank() OVER (PARTITION BY t ORDER BY funding) + (count(*) OVER (PARTITION BY t, funding) - 1) / 2 AS r FROM panel)
SELECT t, count(*) AS n, round(CASE WHEN sum(label::INT) IN (0, count(*)) THEN 0.5 ELSE (sum(r) FILTER (WHERE label) - sum(label::INT) * (sum(label::INT) + 1) / 2) / (sum(label::INT) * (count(*) - sum(label::INT))) END, 6) AS auc FROM k GROUP BY 1""", "panel"))  # fmt: skip
def auc_by_month(s, d):
    return r6(S.auc(V.panel(s, d).withColumn("label", (F.col("taker") > 0.5).cast("int")), ["t"], "funding", "label"))


@query("deciles", sql(f", {_XY}, k AS (SELECT *, ntile(10) OVER (PARTITION BY symbol ORDER BY funding, t) AS bucket FROM xy WHERE y IS NOT NULL) SELECT symbol, bucket::INT AS bucket, count(*) AS n, round(avg(y), 6) AS mean FROM k GROUP BY 1, 2", "panel"))
def deciles(s, d):
    return r6(S.deciles(_xy(s, d).where("y is not null"), ["symbol"], "funding", "y", "t"))


@query("funding_statistics", sql("""
, c AS (SELECT symbol, ts, seq, bps, sum(bps) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM funding),
x AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS top FROM c)
SELECT symbol, count(*) AS n, round(median(bps), 6) AS median, round(avg(bps), 6) AS mean, round(avg(CASE WHEN bps > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, min(bps) AS least, round(max(top - run), 4) AS max_drawdown FROM x GROUP BY 1""", "funding"))  # fmt: skip
def funding_statistics(s, d):
    f = V.funding(s, d)
    a = f.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.median("bps").alias("median"), F.avg("bps").alias("mean"), F.avg(F.when(F.col("bps") > 0, 1.0).otherwise(0.0)).alias("positive"), F.min("bps").alias("least"))
    return r6(a.join(S.max_drawdown_of_sum(f, ["symbol"], ["ts", "seq"], "bps").withColumn("max_drawdown", F.round("max_drawdown", 4)), "symbol"))


@query("variance_ratio", sql("""
, i AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars),
a AS (SELECT symbol, var_samp(r) AS v FROM (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM i) GROUP BY 1),
b AS (SELECT symbol, var_samp(r) AS v, count(r) AS n FROM (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM i WHERE i % 4 = 0) GROUP BY 1)
SELECT symbol, n, round(b.v / (a.v * 4), 6) AS ratio FROM a JOIN b USING (symbol)""", "bars"))  # fmt: skip
def variance_ratio(s, d):
    return r6(S.variance_ratio(V.bars(s, d), "symbol", "ts", "close", 1, 4))


@query("exceedances", sql(f"""
, {_RET}, z AS (SELECT (ret - avg(ret) OVER (PARTITION BY symbol)) / stddev_samp(ret) OVER (PARTITION BY symbol) AS z FROM r WHERE ret IS NOT NULL)
SELECT (SELECT count(z) FROM z) AS n, level, round((SELECT avg(CASE WHEN abs(z) > level THEN 1.0 ELSE 0.0 END) FROM z WHERE z IS NOT NULL), 6) AS share FROM (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS level)""", "panel"))  # fmt: skip
def exceedances(s, d):
    return r6(S.exceedances(_returns(s, d), "symbol", "ret", [1.0, 2.0, 3.0]))


@query("concentration", sql("""
, k AS (SELECT symbol, sum(volume) AS s FROM panel GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, symbol) AS r FROM k)
SELECT count(*) AS keys, round(sum(s), 2) AS total, round(sum(s) FILTER (WHERE r <= 5) / sum(s), 6) AS top_share FROM r""", "panel"))  # fmt: skip
def concentration(s, d):
    c = S.concentration(V.panel(s, d), "symbol", "volume", 5)
    return c.select("keys", F.round("total", 2).alias("total"), V.rounded(F.col("top_share")).alias("top_share"))


@query("purged_split", sql("""
, k AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM panel)
SELECT symbol, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i > floor(n * 0.7) + 6 THEN 'test' ELSE 'purged' END AS part, count(*) AS n, min(t) AS first, max(t) AS last FROM k GROUP BY 1, 2""", "panel"))  # fmt: skip
def purged_split(s, d):
    return S.purged_split(V.panel(s, d), ["symbol"], "t", 6).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("three_way_split", sql("""
, k AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM panel)
SELECT symbol, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i > floor(n * 0.6) + 3 AND i <= floor(n * 0.8) THEN 'valid' WHEN i > floor(n * 0.8) + 3 THEN 'test' ELSE 'purged' END AS part, count(*) AS n FROM k GROUP BY 1, 2""", "panel"))  # fmt: skip
def three_way_split(s, d):
    return S.purged_split(V.panel(s, d), ["symbol"], "t", 3, 0.6, 0.2).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"))


@query("calendar_split", sql("""
, o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM panel), c AS (SELECT min(t) AS cut FROM o WHERE i = least(n - 1, floor(n * 0.7)))
SELECT symbol, CASE WHEN t >= cut THEN 'test' WHEN t + 6 <= cut THEN 'train' ELSE 'purged' END AS part, count(*) AS n FROM panel, c GROUP BY 1, 2""", "panel"))  # fmt: skip
def calendar_split(s, d):
    return S.calendar_split(V.panel(s, d), "t", 6).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"))


@query("standardised", sql("""
, o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM panel), c AS (SELECT min(t) AS cut FROM o WHERE i = least(n - 1, floor(n * 0.7))), m AS (SELECT avg(funding) AS m, stddev_pop(funding) AS s FROM panel, c WHERE t + 6 <= cut)
SELECT t, symbol, round((funding - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END, 6) AS funding FROM panel, m""", "panel"))  # fmt: skip
def standardised(s, d):
    p = S.calendar_split(V.panel(s, d), "t", 6)
    return r6(S.standardise(p, ["funding"], F.col("part") == "train").select("t", "symbol", "funding"))


@query("ridge", sql(f"""
, {_XY} SELECT symbol, count(*) AS n, round(covar_pop(funding, y) * count(*) / (var_pop(funding) * count(*) + 1000), 6) AS coef, round(avg(y) - covar_pop(funding, y) * count(*) / (var_pop(funding) * count(*) + 1000) * avg(funding), 6) AS intercept FROM xy WHERE y IS NOT NULL GROUP BY 1""", "panel"))  # fmt: skip
def ridge(s, d):
    return r6(S.simple_ridge(_xy(s, d), ["symbol"], "funding", "y", 1000.0))


# Sequences ---------------------------------------------------------------------------------------------------------
@query("non_overlapping", sql("""
, e AS (SELECT inst, ts, seq FROM ticks WHERE event_type = 'error'), n AS (SELECT DISTINCT inst, ts, (SELECT min(o.ts) FROM e o WHERE o.inst = e.inst AND o.ts > e.ts + 21600000) AS nxt FROM e),
g AS (SELECT inst, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT n.inst, n.nxt FROM g JOIN n USING (inst, ts) WHERE n.nxt IS NOT NULL)
SELECT inst, ts, seq FROM g JOIN e USING (inst, ts)""", "ticks").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def non_overlapping(s, d):
    e = V.ticks(s, d).where("event_type = 'error'").select("inst", "ts", "seq")
    return sequential.non_overlapping(e, "inst", 6 * HOUR)


@query("rebalance_times", sql("SELECT DISTINCT t FROM panel, (SELECT min(t) AS a, max(t) AS b FROM panel) WHERE (t - a) % 4 = 0 AND t + 4 <= b", "panel"))
def rebalance_times(s, d):
    return sequential.rebalance_times(V.panel(s, d), "t", 4)


@query("within_day_shuffle", sql("""
, b AS (SELECT symbol, ts, close, (ts - 1) // 86400000 AS day, coalesce(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 0) AS step FROM bars),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS i, row_number() OVER (PARTITION BY symbol, day ORDER BY md5('7:' || symbol || ':' || ts), ts) AS j FROM b)
SELECT a.symbol, a.ts, a.close, round(exp(sum(o.step) OVER (PARTITION BY a.symbol ORDER BY a.ts ROWS UNBOUNDED PRECEDING)), 6) AS shuffled FROM n a JOIN n o ON o.symbol = a.symbol AND o.day = a.day AND o.j = a.i""", "bars"))  # fmt: skip
def within_day_shuffle(s, d):
    return r6(sequential.within_day_shuffle(V.bars(s, d), "symbol", 7))


# Account -----------------------------------------------------------------------------------------------------------
@query("liquidation_map", sql("""
, x AS (SELECT coin, CASE WHEN size > 0 THEN 'long' ELSE 'short' END AS side, abs(size) AS size, liq, entry, CASE WHEN size > 0 THEN (entry - liq) / entry ELSE (liq - entry) / entry END AS dist FROM positions)
SELECT coin, side, count(*) AS n, round(sum(CASE WHEN liq IS NULL THEN size ELSE 0 END), 4) AS no_price, round(sum(CASE WHEN dist <= 0 THEN size ELSE 0 END), 4) AS crossed,
       round(sum(CASE WHEN dist > 0 AND dist <= 0.1 + 1e-9 THEN size * liq ELSE 0 END), 2) AS within_10, round(sum(CASE WHEN dist >= 0.25 THEN size * liq ELSE 0 END), 2) AS beyond FROM x GROUP BY 1, 2""", "positions"))  # fmt: skip
def liquidation_map(s, d):
    long = F.col("size") > 0
    p = V.positions(s, d).withColumn("side", F.when(long, "long").otherwise("short")).withColumn("dist", F.when(long, (F.col("entry") - F.col("liq")) / F.col("entry")).otherwise((F.col("liq") - F.col("entry")) / F.col("entry"))).withColumn("q", F.abs("size"))
    add = lambda on, v: F.sum(F.when(on, v).otherwise(0.0))
    x, notional = F.col("dist"), F.col("q") * F.col("liq")
    return p.groupBy("coin", "side").agg(F.count(F.lit(1)).alias("n"), F.round(add(F.col("liq").isNull(), F.col("q")), 4).alias("no_price"), F.round(add(x <= 0, F.col("q")), 4).alias("crossed"), F.round(add((x > 0) & (x <= 0.1 + 1e-9), notional), 2).alias("within_10"), F.round(add(x >= 0.25, notional), 2).alias("beyond"))


@query("liquidation_prices", sql("""
SELECT "user", coin, size, round(CASE WHEN size > 0 THEN CASE WHEN entry * (1 - 1 / 10.0) / (1 - 0.02) * 1.05 > 0 THEN least(entry * (1 - 1 / 10.0) / (1 - 0.02) * 1.05, entry) END ELSE greatest(entry * (1 + 1 / 10.0) / (1 + 0.02) * 0.95, entry) END, 6) AS liq_model,
       round(CASE WHEN size > 0 THEN 1 / (1 - 0.9 * 0.98) ELSE 1 / (1.1 * 1.02 - 1) END, 6) AS max_leverage FROM positions""", "positions"))  # fmt: skip
def liquidation_prices(s, d):
    side = F.signum("size")
    return r6(V.positions(s, d).select("user", "coin", "size", M.liquidation_price(side, "entry", 10.0, 0.02, 0.05).alias("liq_model"), M.max_safe_leverage(side, 0.1, 0.02).alias("max_leverage")))


@query("eligibility_reasons", sql("""
SELECT t, symbol, concat_ws(',', CASE WHEN NOT complete THEN 'incomplete' END, CASE WHEN volume <= 100000 THEN 'volume' END, CASE WHEN funding <= 0 THEN 'carry' END) AS reasons FROM panel""", "panel"))  # fmt: skip
def eligibility_reasons(s, d):
    r = M.reasons({"incomplete": F.col("complete"), "volume": F.col("volume") > 100000, "carry": F.col("funding") > 0})
    return V.panel(s, d).select("t", "symbol", F.array_join(r, ",").alias("reasons"))


@query("labels_ternary", sql("""
SELECT symbol, ts, round((lead(close, 3) OVER o / close - 1) * 1e4, 4) AS fwd, CASE WHEN (lead(close, 3) OVER o / close - 1) * 1e4 >= 50 THEN 1 WHEN (lead(close, 3) OVER o / close - 1) * 1e4 <= -50 THEN -1 ELSE 0 END::INT AS label, ((ts // 86400000 + 3) % 7)::BIGINT AS weekday, ((ts // 3600000) % 24)::BIGINT AS hour FROM bars
WINDOW o AS (PARTITION BY symbol ORDER BY ts) QUALIFY lead(close, 3) OVER o IS NOT NULL""", "bars"))  # fmt: skip
def labels_ternary(s, d):
    b = V.bars(s, d).withColumn("next", F.lead("close", 3).over(W.ordered("symbol"))).where("next is not null")
    raw = (F.col("next") / F.col("close") - 1) * 1e4
    return b.select("symbol", "ts", M.simple_return_bps("next", "close").alias("fwd"), M.ternary(raw, 50.0).alias("label"), M.weekday("ts").alias("weekday"), M.hour("ts").alias("hour"))


@query("seasonality", sql(f"""
, s AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) * 1e4 AS ret FROM bars)
SELECT ((ts // 3600000) % 24)::BIGINT AS hour, count(*) AS n, round(avg(ret), 4) AS mean FROM s WHERE ret IS NOT NULL GROUP BY 1""", "bars"))  # fmt: skip
def seasonality(s, d):
    b = V.bars(s, d).withColumn("ret", W.log_return(W.ordered("symbol"), "close", 1)).where("ret is not null")
    return b.groupBy(M.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 4).alias("mean"))


@query("extreme_moves", sql("""
, r AS (SELECT symbol, ts, close, ln(close / lag(close) OVER o) * 1e4 AS ret, ln(lead(close, 4) OVER o / close) * 1e4 AS fwd FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
z AS (SELECT *, CASE WHEN count(ret) OVER w = 24 THEN stddev_pop(ret) OVER w END AS sd FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS tail, count(*) AS n, round(avg(fwd), 4) AS mean_fwd FROM z WHERE abs(ret) >= 1.5 * sd AND fwd IS NOT NULL GROUP BY 1""", "bars"))  # fmt: skip
def extreme_moves(s, d):
    o = W.ordered("symbol")
    r = V.bars(s, d).withColumn("ret", W.log_return(o, "close", 1)).withColumn("fwd", W.forward_log_return(o, "close", 4))
    before = o.rowsBetween(-24, -1)
    z = r.withColumn("sd", F.when(F.count("ret").over(before) == 24, F.stddev_pop("ret").over(before)))
    return z.where("abs(ret) >= 1.5 * sd and fwd is not null").groupBy(F.when(F.col("ret") > 0, "up").otherwise("down").alias("tail")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fwd"), 4).alias("mean_fwd"))


@query("top_by_volume", sql("SELECT t, symbol, volume, r FROM (SELECT t, symbol, volume, row_number() OVER (PARTITION BY t ORDER BY volume DESC, symbol)::INT AS r FROM panel) WHERE r <= 5", "panel"))
def top_by_volume(s, d):
    w = Window.partitionBy("t").orderBy(F.desc("volume"), "symbol")
    return V.panel(s, d).withColumn("r", F.row_number().over(w)).where("r <= 5").select("t", "symbol", "volume", "r")


@query("latency_percentiles", sql("""
, g AS (SELECT inst, ts - lag(ts) OVER (PARTITION BY inst ORDER BY ts, seq) AS gap FROM ticks)
SELECT inst, count(*) AS n, quantile_cont(gap, 0.5)::DOUBLE AS p50, round(quantile_cont(gap, 0.9), 4) AS p90, max(gap) AS worst FROM g WHERE gap IS NOT NULL GROUP BY 1""", "ticks"))  # fmt: skip
def latency_percentiles(s, d):
    g = V.ticks(s, d).withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("inst").orderBy("ts", "seq"))).where("gap is not null")
    return g.groupBy("inst").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(gap, 0.5)").alias("p50"), F.round(F.expr("percentile(gap, 0.9)"), 4).alias("p90"), F.max("gap").alias("worst"))


@query("settlement_hours", sql("""
, g AS (SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM (SELECT DISTINCT symbol, ts FROM funding))
SELECT symbol, count(gap) AS gaps, round(median(gap) / 3600000, 6) AS hours FROM g GROUP BY 1 HAVING count(gap) >= 3""", "funding"))  # fmt: skip
def settlement_hours(s, d):
    return r6(S.settlement_hours(V.funding(s, d), "symbol", "ts"))


@query("spread_statistics", sql("""
, s AS (SELECT inst, (ask - bid) / ((ask + bid) / 2) * 1e4 AS s FROM touches WHERE bid > 0 AND ask > bid)
SELECT inst, count(*) AS n, round(quantile_cont(s, 0.25), 6) AS p25, round(median(s), 6) AS median, round(quantile_cont(s, 0.75), 6) AS p75, round(avg(CASE WHEN s >= 8 THEN 1.0 ELSE 0.0 END), 6) AS above
FROM s GROUP BY 1 HAVING count(*) >= 10""", "touches"))  # fmt: skip
def spread_statistics(s, d):
    return r6(S.spread_statistics(V.touches(s, d), "inst", 8.0, least=10))


@query("equity_path", sql("""
, r AS (SELECT symbol, ts, seq, greatest(-1.0, bps / 1e4) AS step FROM funding),
e AS (SELECT symbol, ts, seq, exp(sum(ln(1 + step)) OVER w) AS equity FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, 1 - equity / greatest(1.0, max(equity) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS fall FROM e)
SELECT symbol, count(*) AS n, round(arg_max(equity, (ts, seq)), 6) AS equity, round(max(fall), 6) AS max_drawdown FROM p GROUP BY 1""", "funding"))  # fmt: skip
def equity_path(s, d):
    f = V.funding(s, d).withColumn("at", F.struct("ts", "seq"))
    return r6(S.equity_path(f, "symbol", "at", "bps"))


@query("carry_outcomes", sql("""
, r AS (SELECT symbol, ts, sum(bps) AS b FROM funding GROUP BY 1, 2),
x AS (SELECT symbol, ts, round(coalesce(sum(b) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN 1 FOLLOWING AND 2592000000 FOLLOWING), 0) - 10, 6) AS net, max(ts) OVER (PARTITION BY symbol) AS last FROM r),
y AS (SELECT symbol, net, row_number() OVER (PARTITION BY symbol ORDER BY net) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM x WHERE ts + 2592000000 <= last)
SELECT symbol, count(*) AS n, round(median(net), 6) AS median, round(max(net) FILTER (WHERE i = floor(0.05 * (n - 1))), 6) AS p5, round(min(net), 6) AS worst, round(max(net), 6) AS best, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS profitable
FROM y GROUP BY 1""", "funding"))  # fmt: skip
def carry_outcomes(s, d):
    return r6(S.carry_outcomes(V.funding(s, d), "symbol", "ts", "bps", 30 * DAY, 10.0))


@query("panel_geometry", sql("""
, k AS (SELECT t, count(*) AS c FROM panel GROUP BY 1)
SELECT sum(c)::BIGINT AS n, count(*) AS times, round((max(t) - min(t)) / greatest(count(*) - 1, 1), 6) AS spacing, round(avg(c), 6) AS width FROM k""", "panel"))  # fmt: skip
def panel_geometry(s, d):
    return r6(S.panel_geometry(V.panel(s, d), "t"))

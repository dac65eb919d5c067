"""Queries of the research operators: holding windows, dispersion, summaries, conditional fills, levels, resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import sql_functions
from tidemark.operators import research as R
from tidemark.operators import windows as W
from tidemark.plans.registry import _RET, HOUR, _returns, query, r6
from tidemark.sources import views as V
from tidemark.sources.views import sql


@query("window_starts", sql("""
, l AS (SELECT symbol, ts, lag(ts, 6) OVER o AS a, lag(ts, 7) OVER o AS b FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, CASE WHEN a >= ts - 28800000 AND coalesce(b < ts - 28800000, true) AND a - (ts - 28800000) <= 7200000 THEN a END AS start FROM l""", "bars"))  # fmt: skip
def window_starts(s, d):
    return R.window_start(V.bars(s, d), "symbol", 6, 8 * HOUR, 2 * HOUR).select("symbol", "ts", "start")


@query("tick_lag_returns", sql("""
, m AS (SELECT inst, ts, seq, (bid + ask) / 2 AS mid, ts - 3600000 AS at FROM touches), q AS (SELECT inst, ts, arg_max(mid, seq) AS mid FROM m GROUP BY 1, 2)
SELECT m.inst, m.ts, m.seq, round(coalesce(ln(m.mid / q.mid) * 1e4, 0), 6) AS ret FROM m ASOF LEFT JOIN q ON m.inst = q.inst AND m.at >= q.ts""", "touches"))  # fmt: skip
def tick_lag_returns(s, d):
    return r6(R.lagged_returns(V.touches(s, d), "inst", HOUR).select("inst", "ts", "seq", "ret"))


@query("realised_vol_per_second", sql("""
, m AS (SELECT inst, ts, arg_max((bid + ask) / 2, seq) AS mid FROM touches GROUP BY 1, 2), r AS (SELECT *, coalesce(ln(mid / lag(mid) OVER (PARTITION BY inst ORDER BY ts)) ** 2, 0) AS r2 FROM m),
w AS (SELECT inst, ts, count(*) OVER w AS n, (ts - min(ts) OVER w) / 1000 AS span, greatest(0, sum(r2) OVER w - first_value(r2) OVER w) AS later FROM r WINDOW w AS (PARTITION BY inst ORDER BY ts RANGE BETWEEN 43200000 PRECEDING AND CURRENT ROW))
SELECT inst, ts, round(CASE WHEN n < 3 OR span <= 0 THEN 0 ELSE sqrt(later / span) END * 1e4, 6) AS rv_bps FROM w""", "touches"))  # fmt: skip
def realised_vol_per_second(s, d):
    m = V.touches(s, d).groupBy("inst", "ts").agg(F.max_by((F.col("bid") + F.col("ask")) / 2, "seq").alias("mid"))
    return r6(W.realised_vol(m, "inst", 12 * HOUR).select("inst", "ts", (F.col("rv") * 1e4).alias("rv_bps")))


@query("mean_ranges", sql("""
SELECT symbol, ts, CASE WHEN count(*) OVER w = 12 THEN round(avg((high - low) / close) OVER w * 1e4, 6) END AS mean_range FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "bars"))  # fmt: skip
def mean_ranges(s, d):
    return r6(R.mean_range(V.bars(s, d), "symbol", 12).select("symbol", "ts", "mean_range"))


@query("daily_held_eligibility", sql("""
, v AS (SELECT symbol, (ts - 1) // 86400000 AS day, sum(volume) AS v FROM bars GROUP BY 1, 2),
e AS (SELECT symbol, day, count(*) OVER w >= 5 AND median(v) OVER w >= 100 AS eligible FROM v WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT b.symbol, b.ts, coalesce(eligible, false) AS eligible FROM bars b JOIN e ON b.symbol = e.symbol AND (b.ts - 1) // 86400000 = e.day""", "bars"))  # fmt: skip
def daily_held_eligibility(s, d):
    return R.daily_held_eligibility(V.bars(s, d), "symbol", 7, 100.0, 5).select("symbol", "ts", F.coalesce("eligible", F.lit(False)).alias("eligible"))


_MARKET = "r AS (SELECT symbol, ts, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 9) AS ret FROM bars), x AS (SELECT *, round(avg(ret) OVER (PARTITION BY ts), 9) AS market FROM r)"


def _market(s, d):
    r = V.bars(s, d).select("symbol", "ts", F.round(F.log(F.col("close") / F.lag("close").over(W.ordered("symbol"))), 9).alias("ret"))
    return r.withColumn("market", F.round(F.avg("ret").over(Window.partitionBy("ts")), 9))


@query("daily_held_beta", sql(f"""
, {_MARKET}, k AS (SELECT DISTINCT symbol, (ts - 1) // 86400000 AS day FROM x),
b AS (SELECT k.symbol, k.day, covar_pop(x.ret, x.market) / CASE WHEN var_pop(x.market) > 0 THEN var_pop(x.market) END AS beta, stddev_pop(x.ret) AS sd
      FROM k LEFT JOIN x ON x.symbol = k.symbol AND (x.ts - 1) // 86400000 BETWEEN k.day - 5 AND k.day - 1 AND x.ret IS NOT NULL AND x.market IS NOT NULL GROUP BY 1, 2 HAVING count(x.ret) >= 2)
SELECT x.symbol, x.ts, round(beta, 5) AS beta, round(sd, 5) AS sd FROM x LEFT JOIN b ON b.symbol = x.symbol AND b.day = (x.ts - 1) // 86400000""", "bars"))  # fmt: skip
def daily_held_beta(s, d):
    return R.daily_held_beta(_market(s, d), "symbol", 5).select("symbol", "ts", F.round("beta", 5).alias("beta"), F.round("sd", 5).alias("sd"))


@query("gated_bars", sql("""
, k AS (SELECT symbol, ts, close > open AS keep FROM bars WHERE ts // 3600000 % 6 = 0)
SELECT b.symbol, b.ts, coalesce(b.ts - k.ts <= 18000000 AND k.keep, false) AS allowed FROM bars b ASOF LEFT JOIN k ON b.symbol = k.symbol AND b.ts >= k.ts""", "bars"))  # fmt: skip
def gated_bars(s, d):
    b = V.bars(s, d)
    k = b.where(f"ts div {HOUR} % 6 = 0").select("symbol", "ts", (F.col("close") > F.col("open")).alias("keep"))
    return R.gate_hold(b.select("symbol", "ts"), k, "symbol", 5 * HOUR)


_VENUES = """va AS (SELECT symbol // 2 AS coin, t, funding FROM panel WHERE symbol % 2 = 0), vb AS (SELECT symbol // 2 AS coin, t, funding FROM panel WHERE symbol % 2 = 1),
al AS (SELECT coin, t, a.funding AS funding_a, b.funding AS funding_b FROM (SELECT coin, t, first(funding) AS funding FROM va GROUP BY 1, 2 HAVING count(*) = 1) a
       JOIN (SELECT coin, t, first(funding) AS funding FROM vb GROUP BY 1, 2 HAVING count(*) = 1) b USING (coin, t))"""


def _venues(s, d):
    p = V.panel(s, d).select(F.expr("symbol div 2").alias("coin"), "t", "funding", (F.col("symbol") % 2).alias("venue"))
    return R.align_venues(p.where("venue = 0"), p.where("venue = 1"), "coin", "t", ["funding"])


@query("aligned_venues", sql(f", {_VENUES} SELECT coin, t, funding_a, funding_b FROM al", "panel"))
def aligned_venues(s, d):
    return _venues(s, d).select("coin", "t", "funding_a", "funding_b")


@query("dispersion_book", sql(f"""
, {_VENUES}, f AS (SELECT coin, t, funding_a - funding_b AS x FROM al),
w AS (SELECT coin, t, avg(x) OVER b AS m, sum(x) OVER a AS fw, min(t) OVER b = t - 2 AND max(t) OVER a = t + 3 AND count(x) OVER b = 3 AND count(x) OVER a = 3 AS ok FROM f
      WINDOW b AS (PARTITION BY coin ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), a AS (PARTITION BY coin ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(abs(m), 9) DESC, coin) AS k FROM w WHERE ok AND (t - (SELECT min(t) FROM f)) % 3 = 0)
SELECT t, count(*) AS n, round(avg(CASE WHEN m >= 0 THEN -fw ELSE fw END), 6) AS collected, round(avg(CASE WHEN m >= 0 THEN -fw ELSE fw END) - 5, 6) AS net FROM k WHERE k <= 3 GROUP BY 1""", "panel"))  # fmt: skip
def dispersion_book(s, d):
    x = _venues(s, d).select("coin", "t", (F.col("funding_a") - F.col("funding_b")).alias("x"))
    return r6(R.dispersion_book(x, "coin", "t", "x", 3, 3, 3, 5.0))


@query("trade_summary", sql("""
SELECT inst, count(*) AS trades, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(net) FILTER (net > 0), 6) AS mean_win, round(avg(net) FILTER (net <= 0), 6) AS mean_loss, round(sum(net), 6) AS total,
       round(avg(CASE WHEN is_buy THEN 1.0 ELSE 0 END), 6) AS taker_share, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END), 6) AS share_click, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS share_error
FROM (SELECT *, round(price - 50, 4) AS net FROM ticks) GROUP BY 1""", "ticks"))  # fmt: skip
def trade_summary(s, d):
    t = V.ticks(s, d).withColumn("net", F.round(F.col("price") - 50, 4))
    return r6(R.trade_summary(t, ["inst"], "net", "event_type", ("click", "error"), F.col("is_buy")))


@query("fills_by_bucket", sql("""
, e AS (SELECT list_sort(list_distinct(quantile_cont(size, [0.2, 0.4, 0.6, 0.8]))) AS e FROM trades), b AS (SELECT len(list_filter(e, lambda x: x < size)) AS bucket, is_buy, price FROM trades, e),
g AS (SELECT bucket, count(*) AS n, round(avg(CASE WHEN is_buy THEN 1.0 ELSE 0 END), 6) AS fill_rate, avg(price) FILTER (is_buy) AS m FROM b GROUP BY 1)
SELECT bucket, n, fill_rate, round(m, 6) AS markout, row_number() OVER (ORDER BY round(m, 6) DESC NULLS LAST, bucket) = 1 AS best FROM g""", "trades"))  # fmt: skip
def fills_by_bucket(s, d):
    return r6(R.by_bucket(V.trades(s, d), "size", 5, F.col("is_buy"), "price"))


@query("venue_difference", sql("""
, g AS (SELECT inst, avg(price) FILTER (is_buy) AS a, avg(price) FILTER (NOT is_buy) AS b, count(*) FILTER (is_buy) AS na, count(*) FILTER (NOT is_buy) AS nb, var_samp(price) FILTER (is_buy) AS ea, var_samp(price) FILTER (NOT is_buy) AS eb FROM trades GROUP BY 1)
SELECT inst, na AS n_a, nb AS n_b, round(a - b, 6) AS difference, round(sqrt(ea / na + eb / nb), 6) AS se FROM g WHERE na > 1 AND nb > 1""", "trades"))  # fmt: skip
def venue_difference(s, d):
    return r6(R.difference_in_differences(V.trades(s, d), "inst", F.col("is_buy"), "price"))


@query("price_levels", sql("""
, p AS (SELECT symbol, high AS x, row_number() OVER (PARTITION BY symbol ORDER BY high) AS i FROM bars),
f AS (SELECT symbol, 1::BIGINT AS i, x AS mean, 1::BIGINT AS n, 1::BIGINT AS level FROM p WHERE i = 1
  UNION ALL SELECT p.symbol, p.i, CASE WHEN p.x - f.mean <= greatest(f.mean * 0.002, 0.01) THEN (f.mean * f.n + p.x) / (f.n + 1) ELSE p.x END,
                   CASE WHEN p.x - f.mean <= greatest(f.mean * 0.002, 0.01) THEN f.n + 1 ELSE 1 END, CASE WHEN p.x - f.mean <= greatest(f.mean * 0.002, 0.01) THEN f.level ELSE f.level + 1 END
            FROM f JOIN p ON p.symbol = f.symbol AND p.i = f.i + 1)
SELECT symbol, round(arg_max(mean, i), 6) AS level, max(n) AS touches FROM f GROUP BY symbol, f.level""", "bars").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def price_levels(s, d):
    return r6(R.price_levels(V.bars(s, d), "symbol", "high", 0.002, 0.01))


@query("every_scale", sql("""
, a AS (SELECT symbol, ts, avg(close) OVER w AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 6),
b AS (SELECT symbol, ts, avg(close) OVER w AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 24)
SELECT symbol, ts, round(a.m, 6) AS short_m, round(b.m, 6) AS long_m FROM a JOIN b USING (symbol, ts)""", "bars"))  # fmt: skip
def every_scale(s, d):
    def scale(n: int):
        w = W.ordered("symbol").rowsBetween(-n + 1, 0)
        return V.bars(s, d).select("symbol", "ts", F.avg("close").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_n") == n).drop("_n")

    return r6(R.every_scale({"short": scale(6), "long": scale(24)}, ["symbol", "ts"]))


@query("position_fees", """
WITH o AS (SELECT o_orderkey AS leg, o_custkey % 10 AS inst, epoch_us(o_orderdate) // 1000 AS created FROM orders WHERE o_orderkey % 50 = 0),
f AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_orderkey END AS leg, l_suppkey % 10 AS inst, epoch_us(l_shipdate) // 1000 AS ts, l_tax AS fee FROM lineitem),
x AS (SELECT f.leg, fee FROM f JOIN o ON f.leg = o.leg UNION ALL SELECT o.leg, fee FROM f JOIN o ON f.leg IS NULL AND f.inst = o.inst AND f.ts >= o.created - 5000)
SELECT o.leg, round(coalesce(sum(fee), 0), 6) AS fees, count(fee) AS fills FROM o LEFT JOIN x ON o.leg = x.leg GROUP BY 1""".replace(", 6)", " + 1e-9, 6)"))  # fmt: skip
def position_fees(s, d):
    legs = V.table(s, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("leg"), (F.col("o_custkey") % 10).alias("inst"), V.epoch_ms("o_orderdate").alias("created"))
    fills = V.table(s, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_orderkey")).alias("leg"), (F.col("l_suppkey") % 10).alias("inst"), V.epoch_ms("l_shipdate").alias("ts"), F.col("l_tax").alias("fee"))
    return r6(R.position_fees(fills, legs, 5000))


@query("top_decile_bootstrap", sql(f"""
, {_RET}, c AS (SELECT quantile_cont(funding, 0.9) AS cut FROM r WHERE ret IS NOT NULL), g AS (SELECT symbol, sum(ret) AS s, count(*) AS c, row_number() OVER (ORDER BY symbol) - 1 AS i FROM r, c WHERE ret IS NOT NULL AND funding >= cut GROUP BY 1),
n AS (SELECT count(*) AS n FROM g), p AS (SELECT draw, ('0x' || substr(md5('7:' || draw || ':' || k), 1, 8))::BIGINT % n AS i FROM n, unnest(range(200)) a(draw), unnest(range(n)) b(k)),
m AS (SELECT draw, sum(s) / sum(c) AS mean FROM p JOIN g USING (i) GROUP BY 1)
SELECT count(*) AS draws, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM m""", "panel"))  # fmt: skip
def top_decile_bootstrap(s, d):
    return r6(R.top_decile_bootstrap(_returns(s, d).where("ret is not null"), "symbol", "funding", "ret", 200, 7))


@query("ridge_two", sql(f"""
, {_RET}, y AS (SELECT *, lead(ret) OVER (PARTITION BY symbol ORDER BY t) AS y FROM r),
g AS (SELECT symbol, count(*) AS n, avg(funding) AS m0, avg(taker) AS m1, avg(y) AS m2, var_pop(funding) * count(*) + 10 AS a, covar_pop(funding, taker) * count(*) AS b, var_pop(taker) * count(*) + 10 AS c, covar_pop(funding, y) * count(*) AS d, covar_pop(taker, y) * count(*) AS e
      FROM y WHERE y IS NOT NULL AND funding IS NOT NULL AND taker IS NOT NULL GROUP BY 1), s AS (SELECT *, (c * d - b * e) / (a * c - b * b) AS b1, (a * e - b * d) / (a * c - b * b) AS b2 FROM g)
SELECT symbol, n, round(b1, 6) AS b1, round(b2, 6) AS b2, round(m2 - b1 * m0 - b2 * m1, 6) AS intercept FROM s""", "panel"))  # fmt: skip
def ridge_two(s, d):
    y = _returns(s, d).withColumn("y", F.lead("ret").over(W.ordered("symbol", "t")))
    return r6(R.ridge_two(y, ["symbol"], "funding", "taker", "y", 10.0))


@query("archive_plan", """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), m AS (SELECT date_trunc('month', d) AS m, count(*) = day(last_day(any_value(d))) AS w FROM d GROUP BY 1)
SELECT DISTINCT CASE WHEN w THEN 'monthly' ELSE 'daily' END AS kind, CASE WHEN w THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y-%m-%d') END AS period FROM d JOIN m ON m.m = date_trunc('month', d.d)""")  # fmt: skip
def archive_plan(s, d):
    return R.archive_plan(V.table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")))


@query("neutral_trim", sql("""
, v AS (SELECT t, symbol, round(funding, 2) AS v FROM panel WHERE funding IS NOT NULL), n AS (SELECT *, round(sum(v) OVER (PARTITION BY t), 6) AS net FROM v),
b AS (SELECT *, sign(v) = sign(net) AS heavy FROM n), c AS (SELECT *, coalesce(sum(abs(v)) OVER (PARTITION BY t, heavy ORDER BY abs(v) DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT t, symbol, round(v - sign(v) * CASE WHEN heavy THEN least(abs(v), greatest(abs(net) - before, 0)) ELSE 0 END, 4) AS trimmed FROM c""", "panel"))  # fmt: skip
def neutral_trim(s, d):
    v = V.panel(s, d).where("funding is not null").select("t", "symbol", F.round("funding", 2).alias("v"))
    return R.neutral_trim(v, "t", "symbol", "v").select("t", "symbol", (F.round("trimmed", 4) + 0.0).alias("trimmed"))


@query("seasonality_by_year", sql(f"""
, r AS (SELECT symbol, ts, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) * 1e4, 6) AS ret FROM bars),
k AS (SELECT ret, ts // 3600000 % 24 AS hour, (ts // 86400000 + 3) % 7 AS wd, year(make_timestamp(ts * 1000)) AS y FROM r),
u AS (SELECT 'hour' AS kind, hour AS slot, y, ret FROM k UNION ALL SELECT 'weekday', wd, y, ret FROM k)
SELECT kind, slot::INTEGER AS slot, y::INTEGER AS year, count(ret) AS n, round(avg(ret), 6) AS mean FROM u GROUP BY GROUPING SETS ((kind, slot, y), (kind, slot))""", "bars"))  # fmt: skip
def seasonality_by_year(s, d):
    r = V.bars(s, d).withColumn("ret", F.round(F.log(F.col("close") / F.lag("close").over(W.ordered("symbol"))) * 1e4 + 1e-9, 6))
    return r6(R.seasonality(r, "ret", F.expr(f"ts div {HOUR} % 24"), F.expr("(ts div 86400000 + 3) % 7"), F.year(F.timestamp_millis("ts"))))


@query("sql_functions", sql("""
SELECT symbol, ts, round(ln(close / open) * 1e4, 6) AS ret, CASE WHEN close > open * 1.001 THEN 1 WHEN close < open * 0.999 THEN -1 ELSE 0 END AS label,
       round(exp(0.5 * ln(high) + 0.5 * ln(low)), 6) AS centre, CASE WHEN high > low THEN round((close - low) / (high - low), 6) ELSE 0.5 END AS place FROM bars""", "bars"))  # fmt: skip
def sql_function_query(s, d):
    sql_functions.register(s)
    return r6(V.bars(s, d).selectExpr("symbol", "ts", "log_return_bps(open, close) AS ret", "ternary_label(open, close, 10) AS label", "log_blend(high, low, 0.5) AS centre", "range_place(close, high, low) AS place"))


_TAIL = "(1 / (1 + 0.3275911::DOUBLE * k / sqrt(2)))"
_GAUSS = f"({_TAIL} * (0.254829592::DOUBLE + {_TAIL} * (-0.284496736::DOUBLE + {_TAIL} * (1.421413741::DOUBLE + {_TAIL} * (-1.453152027::DOUBLE + {_TAIL} * 1.061405429::DOUBLE)))) * exp(-k * k / 2))"


@query("touch_calibration", sql(f"""
, {_RET}, z AS (SELECT abs(ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) AS z FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol)),
g AS (SELECT k, count(*) AS n, avg(CASE WHEN z > k THEN 1.0::DOUBLE ELSE 0 END) AS observed, any_value({_GAUSS}) AS gaussian FROM z, unnest([0.5::DOUBLE, 1, 1.5, 2, 2.5, 3]) u(k) WHERE z IS NOT NULL GROUP BY 1)
SELECT k AS distance, n, round(observed, 6) AS observed, round(gaussian, 6) AS gaussian, round(observed / gaussian, 6) AS ratio,
       sum(CASE WHEN observed / gaussian > 2 OR observed / gaussian < 0.5 THEN 1 ELSE 0 END) OVER (ORDER BY k) = 0 AS calibrated FROM g""", "panel"))  # fmt: skip
def touch_calibration(s, d):
    return r6(R.touch_calibration(_returns(s, d), "symbol", "ret", [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]))


@query("threshold_short", sql(f"""
, {_RET}, x AS (SELECT symbol, t, ret, CASE WHEN lag(t, 1) OVER o = t - 1 THEN lag(funding, 1) OVER o END AS f FROM r WINDOW o AS (PARTITION BY symbol ORDER BY t)),
g AS (SELECT t, count(*) AS names, avg(f - ret) AS net FROM x WHERE f > 5 AND ret IS NOT NULL GROUP BY 1)
SELECT count(net) AS periods, round(avg(net), 6) AS mean, round(avg(net) / stddev_samp(net) * sqrt(12), 6) AS sharpe FROM g""", "panel"))  # fmt: skip
def threshold_short(s, d):
    return r6(R.sharpe(R.threshold_short(_returns(s, d), "symbol", "t", "funding", "ret", 5.0, 1), "net", 12.0))


@query("latest_states", """
WITH p AS (SELECT l_suppkey AS k, l_returnflag AS part, arg_max({'q': l_quantity, 'v': l_extendedprice}, {'t': l_shipdate, 'q': l_quantity, 'v': l_extendedprice}) AS s FROM lineitem GROUP BY 1, 2)
SELECT k AS account, count(*) AS parts, md5(string_agg(part || ':' || printf('%.6f', s.q) || ':' || printf('%.6f', s.v), '|' ORDER BY part)) AS fingerprint FROM p GROUP BY 1""")  # fmt: skip
def latest_states(s, d):
    return R.latest_states(V.table(s, d, "lineitem").withColumnRenamed("l_suppkey", "account"), "account", "l_returnflag", "l_shipdate", ["l_quantity", "l_extendedprice"])


@query("book_scorecard", sql("""
, g AS (SELECT coin, sum(abs(value)) AS gross, sum(sign(size) * abs(value)) AS net FROM positions GROUP BY 1)
SELECT coin, round(gross, 2) AS gross, round(net, 2) AS net, round(net / gross, 6) AS net_frac, abs(net / gross) > 0.02 AS alert FROM g""", "positions"))  # fmt: skip
def book_scorecard(s, d):
    c = R.book_scorecard(V.positions(s, d), "coin", "size", "value")
    return c.select("coin", F.round("gross", 2).alias("gross"), F.round("net", 2).alias("net"), V.rounded(F.col("net_frac")).alias("net_frac"), "alert")


_LEAK = "(SELECT '{0}' AS feature, count(*) AS n, corr(a, b) AS ic FROM (SELECT rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM xy WHERE {0} IS NOT NULL AND y IS NOT NULL))"


@query("leakage_flags", sql(f"""
, {_RET}, xy AS (SELECT funding, taker, round(ret, 6) AS ret, round(ret, 6) AS y FROM r), l AS ({' UNION ALL '.join(_LEAK.format(c) for c in ('funding', 'taker', 'ret'))})
SELECT feature, n, round(ic, 6) AS ic, abs(ic) > 0.2 AS suspicious FROM l""", "panel"))  # fmt: skip
def leakage_flags(s, d):
    r = _returns(s, d).withColumn("ret", F.round(F.col("ret") + 1e-9, 6)).withColumn("y", F.col("ret"))
    return r6(R.leakage_flags(r, ["funding", "taker", "ret"], "y"))


@query("harness", sql(f"""
, {_RET}, y0 AS (SELECT *, round(lead(ret) OVER (PARTITION BY symbol ORDER BY t), 6) AS y FROM r), o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM panel), c AS (SELECT min(t) AS cut FROM o WHERE i = least(n - 1, floor(n * 0.7))),
g AS (SELECT count(*) AS n, avg(funding) AS m0, avg(taker) AS m1, avg(y) AS m2, var_pop(funding) * count(*) + 10 AS a, covar_pop(funding, taker) * count(*) AS b, var_pop(taker) * count(*) + 10 AS c, covar_pop(funding, y) * count(*) AS d, covar_pop(taker, y) * count(*) AS e
      FROM y0, c WHERE t + 2 <= cut AND y IS NOT NULL AND funding IS NOT NULL AND taker IS NOT NULL),
f AS (SELECT (c * d - b * e) / (a * c - b * b) AS b1, (a * e - b * d) / (a * c - b * b) AS b2, m0, m1, m2 FROM g),
p AS (SELECT symbol, y, round(m2 - b1 * m0 - b2 * m1 + b1 * funding + b2 * taker, 9) AS p FROM y0, f, c WHERE t >= cut AND y IS NOT NULL AND funding IS NOT NULL AND taker IS NOT NULL),
k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS b FROM p)
SELECT symbol, count(*) AS n, round(corr(a, b), 6) AS ic FROM k GROUP BY 1""", "panel"))  # fmt: skip
def harness(s, d):
    from tidemark.operators import statistics as S

    y = _returns(s, d).withColumn("y", V.rounded(F.lead("ret").over(W.ordered("symbol", "t"))))
    return r6(R.harness(S.calendar_split(y, "t", 2), "symbol", "funding", "taker", "y", 10.0))


@query("liquidation_bands", sql("""
, x AS (SELECT coin, size, liq, CASE WHEN size > 0 THEN (entry - liq) / entry ELSE (liq - entry) / entry END AS dist FROM positions WHERE liq IS NOT NULL)
SELECT coin, CASE WHEN size > 0 THEN 'long' ELSE 'short' END AS side, CASE WHEN dist <= 0 THEN -1 WHEN dist >= 0.25 THEN 50 ELSE floor(round(dist / 0.005, 6)) END::INTEGER AS band, count(*) AS n, round(sum(abs(size) * liq), 2) AS notional FROM x GROUP BY 1, 2, 3""", "positions").replace(" + 1e-9, 6)", ", 6)"))  # fmt: skip
def liquidation_bands(s, d):
    p = V.positions(s, d).where("liq is not null")
    dist = F.when(F.col("size") > 0, (F.col("entry") - F.col("liq")) / F.col("entry")).otherwise((F.col("liq") - F.col("entry")) / F.col("entry"))
    band = F.when(dist <= 0, -1).when(dist >= 0.25, 50).otherwise(F.floor(F.round(dist / 0.005, 6))).cast("int")
    side = F.when(F.col("size") > 0, "long").otherwise("short")
    return p.groupBy("coin", side.alias("side"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("size") * F.col("liq")), 2).alias("notional"))

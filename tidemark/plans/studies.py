"""Queries of factor libraries, reports, event studies and account books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.operators import account, joins, sequential, universe
from tidemark.operators import cross_section as X
from tidemark.operators import statistics as S
from tidemark.operators import studies as T
from tidemark.operators import windows as W
from tidemark.plans.registry import _BOOK, _FACT, _RET, _XY, DAY, HOUR, _returns, _scored, _xy, passive_fills, query, r6
from tidemark.sources import sinks
from tidemark.sources import views as V
from tidemark.sources.views import sql

_GRID = "g AS (SELECT k.symbol, e.t FROM (SELECT DISTINCT symbol FROM panel) k, (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM panel) e)"


def daily(text: str) -> str:
    """The SQL of hourly bars for bars of a day."""
    return text.replace("3600000", "86400000")


# Universe and factors -----------------------------------------------------------------------------------------------
@query("tradeable", sql(f"""
, {_GRID}, d AS (SELECT g.symbol, g.t, volume, coalesce(complete, FALSE) AS ok FROM g LEFT JOIN panel USING (symbol, t)),
x AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY t) AS off, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i,
      median(volume) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM d),
y AS (SELECT *, (sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, off ORDER BY t))::BIGINT AS run FROM x)
SELECT symbol, t, run, round(m, 4) AS median_volume, coalesce(i > 6 AND run >= 4 AND m >= 100000, FALSE) AS eligible FROM y""", "panel"))  # fmt: skip
def tradeable(s, d):
    return universe.tradeable(V.panel(s, d), "symbol", "t", 4, 100000, 6).withColumn("median_volume", F.round("median_volume", 4))


@query("volatility_regimes", sql(f"""
, {_RET}, v AS (SELECT symbol, t, round(abs(ret), 6) AS rv FROM r WHERE ret IS NOT NULL),
w AS (SELECT *, list(rv) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past, list_sort(list(rv) FILTER (WHERE rv > 0) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) AS seen FROM v),
z AS (SELECT *, len(list_filter(past, lambda x: x < rv)) / len(past) AS share FROM w)
SELECT symbol, t, CASE WHEN coalesce(len(past), 0) < 8 THEN 'unknown' WHEN share < 1.0::DOUBLE / 3 THEN 'low' WHEN share > 2.0::DOUBLE / 3 THEN 'high' ELSE 'normal' END AS by_prior,
       CASE WHEN coalesce(len(seen), 0) < 6 THEN 'unknown' WHEN rv <= seen[floor(len(seen) * 0.33)::INT + 1] THEN 'low_vol' WHEN rv >= seen[floor(len(seen) * 0.67)::INT + 1] THEN 'high_vol' ELSE 'normal_vol' END AS by_samples FROM z""", "panel"))  # fmt: skip
def volatility_regimes(s, d):
    v = _returns(s, d).where("ret is not null").select("symbol", "t", V.rounded(F.abs("ret")).alias("rv"))
    o = W.ordered("symbol", "t")
    return v.select("symbol", "t", universe.regime_of_prior(o, "rv", 20, 8).alias("by_prior"), universe.regime_of_samples(o, "rv", 12, 6).alias("by_samples"))


@query("trailing_beta", sql(f"""
, {_RET}, m AS (SELECT *, avg(ret) OVER (PARTITION BY t) AS market FROM r)
SELECT symbol, t, round(CASE WHEN count(ret) OVER w = 12 AND var_pop(market) OVER w > 0 THEN covar_pop(ret, market) OVER w / var_pop(market) OVER w END, 6) AS beta FROM m
WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "panel"))  # fmt: skip
def trailing_beta(s, d):
    return r6(universe.with_market(_returns(s, d), "t", "ret").select("symbol", "t", universe.trailing_beta(W.ordered("symbol", "t"), "ret", 12).alias("beta")))


def _over(w: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _mean(c: str, w: int) -> str:
    return f"CASE WHEN count(*) OVER {_over(w)} = {w} THEN avg({c}) OVER {_over(w)} END"


def _logret(w: int) -> str:
    return f"ln(close / lag(close, {w}) OVER (PARTITION BY symbol ORDER BY t)) * 1e4"


def _after(x: str) -> str:
    return f"CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY t) > 30 THEN {x} END"


_STD = _after(f"CASE WHEN count(ret) OVER {_over(30)} = 30 THEN stddev_pop(ret) OVER {_over(30)} END")
_FACTORS = (
    {f"carry_{w}": f"-(CASE WHEN count(*) OVER {_over(w)} = {w} THEN sum(coalesce(funding, 0)) OVER {_over(w)} END) / {w}" for w in (1, 3, 7, 14, 30, 60)}
    | {f"mom_{w}": _logret(w) for w in (7, 14, 30)}
    | {f"rev_{w}": f"-({_logret(w)})" for w in (1, 3)}
    | {
        "lowvol_30": f"-({_STD})", "lowrv_30": f"-({_mean('rv', 30)})", "illiq_30": _mean("abs(ret) / volume", 30), "small_30": _mean("-ln(volume)", 30), "taker_7": _mean("taker", 7),
        "rangepos_30": _after(f"-(close - min(low) OVER {_over(30)}) / (max(high) OVER {_over(30)} - min(low) OVER {_over(30)})"), "rvshock_7": f"-({_mean('rv', 7)}) / ({_mean('rv', 30)})",
        "carry_accel": f"-(CASE WHEN count(*) OVER {_over(3)} = 3 THEN sum(funding) OVER {_over(3)} END) / 3 + (CASE WHEN count(*) OVER {_over(30)} = 30 THEN sum(funding) OVER {_over(30)} END) / 30",
        "max_7": f"-(CASE WHEN count(*) OVER {_over(7)} = 7 THEN max(ret) OVER {_over(7)} END)",
        "beta_30": _after(f"-(CASE WHEN count(ret) OVER {_over(30)} = 30 THEN covar_pop(ret, market) OVER {_over(30)} / var_pop(market) OVER {_over(30)} END)"),
        "skew_30": _after(f"CASE WHEN count(ret) OVER {_over(30)} = 30 THEN -(avg(pow(ret, 3)) OVER {_over(30)} - 3 * avg(ret) OVER {_over(30)} * avg(pow(ret, 2)) OVER {_over(30)} + 2 * pow(avg(ret) OVER {_over(30)}, 3)) / pow(stddev_pop(ret) OVER {_over(30)}, 3) END"),
        "volshock_1": f"-ln(volume / ({_mean('volume', 30)}))", "carry_vol": f"-(sum(funding) OVER {_over(7)}) / 7 / ({_STD})", "mom_vol": f"{_logret(14)} / ({_STD})",
    }
)


@query("daily_factors", sql(f", {_RET}, f AS (SELECT *, avg(ret) OVER (PARTITION BY t) AS market, close * 1.01::DOUBLE AS high, close * 0.99::DOUBLE AS low, abs(ret) AS rv FROM r) SELECT symbol, t, {', '.join(f'round({x} + 1e-9, 4) + 0 AS {n}' for n, x in _FACTORS.items())} FROM f", "panel"))
def daily_factors(s, d):
    p = V.panel(s, d).withColumn("high", F.col("close") * 1.01).withColumn("low", F.col("close") * 0.99).withColumn("rv", F.abs(W.log_return(W.ordered("symbol", "t"), "close", 1)))
    return universe.daily_factors(p).select("symbol", "t", *[V.rounded(F.col(n), 4).alias(n) for n in _FACTORS])


@query("oi_factors", sql("""
, d AS (SELECT symbol, ts, close, volume, sum(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS oi FROM bars),
l AS (SELECT *, ln(oi / lag(oi, 1) OVER o) AS d1, ln(oi / lag(oi, 4) OVER o) AS d4, ln(oi / lag(oi, 24) OVER o) AS d24, sign(ln(close / lag(close, 1) OVER o)) AS s1, sign(ln(close / lag(close, 24) OVER o)) AS s24,
  CASE WHEN count(*) OVER m = 30 THEN avg(volume) OVER m END AS v30, CASE WHEN count(*) OVER h = 24 THEN avg(volume) OVER h END AS v24, oi - lag(oi, 24) OVER o AS moved FROM d
  WINDOW o AS (PARTITION BY symbol ORDER BY ts), m AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), h AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, round(d1, 6) AS doi_1, round(d4, 6) AS doi_4, round(d24, 6) AS doi_24, round(-s1 * d1, 6) AS newlongs_1, round(-s24 * d24, 6) AS newlongs_24, round(-ln(oi / v30), 6) AS oi_lvl, round(-abs(moved) / v24, 6) AS oi_vol FROM l""", "bars"))  # fmt: skip
def oi_factors(s, d):
    b = V.bars(s, d).withColumn("oi", F.sum("volume").over(W.ordered("symbol").rowsBetween(-9, 0)))
    return r6(universe.oi_factors(b, "symbol", "ts"))


@query("range_dataset", daily(sql("""
, w AS (SELECT *, pow(coalesce(ln(close / lag(close) OVER o), 0), 2) AS r2, pow(ln(high / low), 2) AS p2 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
x AS (SELECT *, max(high) OVER a AS hi, min(low) OVER a AS lo, max(high) OVER b AS hi4, min(low) OVER b AS lo4, max(high) OVER f AS fh, min(low) OVER f AS fl, lag(close, 2) OVER o AS was, sqrt(avg(r2) OVER a) AS rv,
   sqrt(lag(r2) OVER o) AS rvs, sqrt(avg(p2) OVER a / (4 * 0.6931471805599453::DOUBLE)) AS pk, ts - lag(ts, 8) OVER o = 8 * 3600000 AND lead(ts, 2) OVER o - ts = 2 * 3600000 AS ok FROM w
   WINDOW o AS (PARTITION BY symbol ORDER BY ts), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT symbol, ts, round(ln(hi / lo), 6) AS log_width, round(ln(rv + 1e-12), 6) AS rv, round(ln(pk + 1e-12), 6) AS parkinson, round(ln((rvs + 1e-12) / (rv + 1e-12)), 6) AS vol_ratio, round(ln(close / was), 6) AS ret,
   round((close - lo) / (hi - lo), 6) AS pos_in_range, round(ln(hi / close), 6) AS dist_high, round(ln(close / lo), 6) AS dist_low, round(abs(ln(close / was)) / ln(hi / lo), 6) AS trend_ratio, round(ln(ln(hi / lo) / ln(hi4 / lo4)), 6) AS width_ratio,
   round(ln(sqrt(fh * fl) / close), 6) AS centre, round(ln(fh / fl), 6) AS width, (fh <= hi AND fl >= lo)::INT::DOUBLE AS contained FROM x WHERE ok AND hi > lo AND hi4 > lo4""", "bars")))  # fmt: skip
def range_dataset(s, d):
    return r6(universe.range_dataset(V.bars(s, d, DAY), "symbol", DAY, 2, 2))


@query("sideways", daily(sql("""
, x AS (SELECT symbol, ts, close, lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS was, max(high) OVER r AS hi, min(low) OVER r AS lo FROM bars WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
y AS (SELECT symbol, ts, close / was - 1 AS move, CASE WHEN hi > lo THEN abs(close - was) / (hi - lo) ELSE 'inf'::DOUBLE END AS trend, (hi - lo) / ((hi + lo) / 2) AS width FROM x WHERE was IS NOT NULL),
l AS (SELECT symbol, arg_max(move, ts) AS move, arg_max(trend, ts) AS trend, arg_max(width, ts) AS width FROM y GROUP BY 1)
SELECT symbol, round(any_value(l.move), 6) AS move, round(any_value(l.width), 6) AS width, round(any_value(l.trend), 6) AS trend, round(avg(CASE WHEN y.trend <= l.trend THEN 1.0 ELSE 0.0 END), 6) AS trend_share,
       round(avg(CASE WHEN y.width <= l.width THEN 1.0 ELSE 0.0 END), 6) AS width_share, count(*) AS windows FROM y JOIN l USING (symbol) GROUP BY 1""", "bars")))  # fmt: skip
def sideways(s, d):
    return r6(universe.sideways(V.bars(s, d, DAY), "symbol", "ts", 5))


# Reports ------------------------------------------------------------------------------------------------------------
_LONG = f"{_XY}, l AS (SELECT symbol, y, unnest(['funding', 'taker', 'volume']) AS feature, unnest([funding, taker, volume]) AS x FROM xy WHERE y IS NOT NULL)"


@query("ic_report", sql(f"""
, {_LONG}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS b FROM l),
c AS (SELECT feature, count(*) AS n, corr(x, y) AS p, corr(a, b) AS s FROM k GROUP BY 1)
SELECT feature, n, round(p, 6) AS pearson, round(s, 6) AS spearman, round(CASE WHEN floor(n / 3.0) <= 2 THEN 0 ELSE p * sqrt((floor(n / 3.0) - 2) / (1 - least(p * p, 0.999999))) END, 6) AS t_stat, abs(p) > 0.2 AS suspicious FROM c""", "panel"))  # fmt: skip
def ic_report(s, d):
    return r6(T.ic_report(_xy(s, d), ["funding", "taker", "volume"], "y", 3.0))


@query("sign_agreement", sql(f"""
, {_LONG}, c AS (SELECT symbol, feature, CASE WHEN count(*) < 3 OR stddev_pop(x) < 1e-12 OR stddev_pop(y) < 1e-12 THEN 0 ELSE corr(x, y) END AS c FROM l GROUP BY 1, 2),
n AS (SELECT feature, sum(CASE WHEN c > 0 THEN 1 ELSE 0 END)::BIGINT AS positive, count(*) AS groups, avg(c) AS mean FROM c GROUP BY 1)
SELECT feature, positive, groups, round(mean, 6) AS mean, round(least(1.0, 2 * (SELECT sum(exp(lgamma(groups + 1) - lgamma(i + 1) - lgamma(groups - i + 1) - groups * ln(2))) FROM unnest(range(greatest(positive, groups - positive), groups + 1)) u(i))), 6) AS chance FROM n""", "panel"))  # fmt: skip
def sign_agreement(s, d):
    return r6(T.sign_agreement(_xy(s, d).where("y is not null"), "symbol", ["funding", "taker", "volume"], "y"))


@query("economic_test", sql(f"""
, {_XY}, q AS (SELECT symbol, quantile_cont(funding, 0.9) AS q9, quantile_cont(funding, 0.1) AS q1 FROM xy WHERE y IS NOT NULL GROUP BY 1),
e AS (SELECT symbol, count(*) AS n, avg(y) AS drift, avg(y) FILTER (WHERE funding >= q9) AS top, avg(y) FILTER (WHERE funding <= q1) AS bottom FROM xy JOIN q USING (symbol) WHERE y IS NOT NULL GROUP BY 1)
SELECT symbol, n, round(drift, 6) AS drift, round(top, 6) AS top, round(bottom, 6) AS bottom, round(top - drift, 6) AS long_edge, round(drift - bottom, 6) AS short_edge, greatest(top - drift, drift - bottom) > 10 AS tradeable FROM e""", "panel"))  # fmt: skip
def economic_test(s, d):
    return r6(T.economic_test(_xy(s, d).where("y is not null"), ["symbol"], "funding", "y", 10.0))


_MOVES = f", {_FACT}, {_BOOK.format(more='')}, fw AS (SELECT symbol, t, ret, lead(ret) OVER (PARTITION BY symbol ORDER BY t) AS fwd FROM r)"


@query("run_summary", sql(f"""
{_MOVES}, n AS (SELECT t, sum(weight * fwd) AS net, sum(abs(weight)) AS turnover FROM b JOIN fw USING (symbol, t) WHERE fwd IS NOT NULL GROUP BY 1), m AS (SELECT t, avg(fwd) AS market FROM fw WHERE fwd IS NOT NULL GROUP BY 1),
a AS (SELECT t // 12 AS year, count(*) AS periods, avg(net) AS net, stddev_samp(net) AS sd, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(turnover) AS turnover, covar_samp(net, market) AS c, var_samp(market) AS v, avg(market) AS mm FROM n JOIN m USING (t) GROUP BY 1 HAVING count(*) >= 2),
z AS (SELECT *, c / v AS beta, net - c / v * mm AS alpha, sqrt(greatest(0, sd * sd - 2 * c / v * c + c / v * c / v * v) / periods) AS e FROM a)
SELECT year, periods, round(net, 4) AS net, round(sd, 4) AS sd, round(hit, 4) AS hit, round(turnover, 4) AS turnover, round(net / sd * sqrt(12), 4) AS sharpe, round(net / (sd / sqrt(periods)), 4) AS t_stat, round(net - 1.96::DOUBLE * sd / sqrt(periods), 4) AS lo,
       round(net + 1.96::DOUBLE * sd / sqrt(periods), 4) AS hi, round(beta, 4) AS beta, round(alpha, 4) AS alpha, round(alpha / e, 4) AS alpha_t FROM z""", "panel"))  # fmt: skip
def run_summary(s, d):
    fwd = _returns(s, d).withColumn("fwd", F.lead("ret").over(W.ordered("symbol", "t"))).where("fwd is not null").select("symbol", "t", "fwd")
    net = X.book(_scored(s, d), "blend").join(fwd, ["symbol", "t"]).groupBy("t").agg(F.sum(F.col("weight") * F.col("fwd")).alias("net"), F.sum(F.abs("weight")).alias("turnover"))
    out = T.run_summary(net.join(fwd.groupBy("t").agg(F.avg("fwd").alias("market")), "t").withColumn("year", F.expr("t div 12")), ["year"], 12.0)
    return out.select(*[F.round(c, 4).alias(c) if k == "double" else c for c, k in out.dtypes])


@query("capacity", sql(f", {_FACT}, {_BOOK.format(more='')} SELECT t, round(min(0.01 * volume / (abs(weight) / 2)), 2) AS ceiling, count(*) AS names FROM b JOIN panel USING (t, symbol) WHERE volume > 0 GROUP BY 1", "panel"))
def capacity(s, d):
    return T.capacity(X.book(_scored(s, d), "blend"), V.panel(s, d).select("t", "symbol", "volume"), "t", "symbol", 0.01).withColumn("ceiling", F.round("ceiling", 2))


@query("funding_autocorrelation", sql("""
, d AS (SELECT symbol, funding, count(funding) OVER (PARTITION BY symbol) AS n, lag(funding, 1) OVER o AS a, lag(funding, 3) OVER o AS b, lag(funding, 7) OVER o AS c, lag(funding, 14) OVER o AS e FROM panel WINDOW o AS (PARTITION BY symbol ORDER BY t)),
p AS (SELECT symbol, corr(funding, a) AS a, corr(funding, b) AS b, corr(funding, c) AS c, corr(funding, e) AS e FROM d WHERE n > 30 GROUP BY 1), u AS (SELECT unnest([1, 3, 7, 14]) AS lag, unnest([a, b, c, e]) AS v FROM p)
SELECT lag, count(v) AS keys, round(avg(v), 6) AS corr FROM u GROUP BY 1""", "panel"))  # fmt: skip
def funding_autocorrelation(s, d):
    return r6(T.autocorrelations(V.panel(s, d), "symbol", "t", "funding", [1, 3, 7, 14]))


@query("weekly_blocks", sql(f", {_RET}, b AS (SELECT symbol, ret, (row_number() OVER (PARTITION BY symbol ORDER BY t) - 1) // 7 AS block FROM r WHERE ret IS NOT NULL) SELECT symbol, block, round(sum(ret), 4) AS total FROM b GROUP BY 1, 2 HAVING count(*) = 7", "panel"))
def weekly_blocks(s, d):
    return T.blocks(_returns(s, d).where("ret is not null"), "symbol", "t", "ret", 7).withColumn("total", F.round("total", 4))


@query("block_bootstrap", sql(f"""
, {_RET}, m AS (SELECT t, avg(ret) AS v, row_number() OVER (ORDER BY t) - 1 AS i FROM r WHERE ret IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS n, avg(v) AS mean FROM m),
p AS (SELECT draw, b, k, n, ('0x' || substr(md5('7:' || draw || ':' || b), 1, 8))::BIGINT % (n - 3) + k AS i FROM n, unnest(range(1000)) x(draw), unnest(range(0, (n - 1) // 4 + 1)) y(b), unnest(range(4)) z(k) WHERE b * 4 + k < n),
d AS (SELECT draw, avg(v) AS v FROM p JOIN m USING (i) GROUP BY 1)
SELECT any_value(n) AS n, round(any_value(mean), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(*) AS draws FROM d, n""", "panel"))  # fmt: skip
def block_bootstrap(s, d):
    m = _returns(s, d).where("ret is not null").groupBy("t").agg(F.avg("ret").alias("market"))
    return r6(T.block_bootstrap(m, "t", "market", 4, 1000, 7))


@query("shuffled_scores", sql("""
, d AS (SELECT t, symbol, funding, row_number() OVER (PARTITION BY t ORDER BY symbol) AS i, row_number() OVER (PARTITION BY t ORDER BY md5('7:' || t || ':' || symbol), symbol) AS j FROM panel WHERE funding IS NOT NULL)
SELECT a.t, a.symbol, a.funding, b.funding AS shuffled FROM d a JOIN d b ON b.t = a.t AND b.j = a.i""", "panel"))  # fmt: skip
def shuffled_scores(s, d):
    return T.shuffled_scores(V.panel(s, d), "t", "symbol", "funding", 7).select("t", "symbol", "funding", "shuffled")


@query("decimated", sql("SELECT t, symbol, close FROM panel JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM (SELECT DISTINCT t FROM panel)) USING (t) WHERE k % 5 = 0", "panel"))
def decimated(s, d):
    return T.decimated(V.panel(s, d), "t", 5).select("t", "symbol", "close")


# Fills --------------------------------------------------------------------------------------------------------------
@query("markouts", sql("""
, q AS (SELECT seq AS q_id, inst, ts, 'bid' AS side, bid AS price, bid_sz AS queue FROM touches UNION ALL SELECT -seq, inst, ts, 'ask', ask, ask_sz FROM touches),
m AS (SELECT q.*, t.ts AS t_ts, sum(t.size) OVER (PARTITION BY q.q_id ORDER BY t.ts, t.seq) AS run FROM q JOIN trades t ON t.inst = q.inst AND t.ts > q.ts AND t.ts <= q.ts + 7200000
      AND CASE WHEN side = 'bid' THEN NOT t.is_buy AND t.price <= q.price * (1 + 1e-9) ELSE t.is_buy AND t.price >= q.price * (1 - 1e-9) END),
f AS (SELECT q_id, inst, side, price, min(t_ts) AS ts FROM m WHERE run > queue GROUP BY ALL), z AS (SELECT f.*, (t.bid + t.ask) / 2 AS mid0 FROM f ASOF JOIN touches t ON t.inst = f.inst AND t.ts <= f.ts),
h AS (SELECT z.* EXCLUDE (ts), horizon, ts + horizon AS ts FROM z, (SELECT unnest([60000, 3600000, 21600000])::BIGINT AS horizon)),
g AS (SELECT h.side, h.horizon, CASE WHEN side = 'bid' THEN (t.bid + t.ask) / 2 - price ELSE price - (t.bid + t.ask) / 2 END / mid0 * 1e4 AS g FROM h ASOF JOIN touches t ON t.inst = h.inst AND t.ts <= h.ts)
SELECT side, horizon, count(*) AS n, round(avg(g), 4) AS mean, round(stddev_samp(g) / sqrt(count(*)), 4) AS se FROM g GROUP BY 1, 2""", "touches", "trades"))  # fmt: skip
def markouts(s, d):
    q = V.touches(s, d)
    price = q.select(F.col("seq").alias("q_id"), F.col("bid").alias("price")).unionByName(q.select((-F.col("seq")).alias("q_id"), F.col("ask").alias("price")))
    f = passive_fills(s, d).where("fill_ts is not null").join(price, "q_id")
    return T.markouts(f, q, "inst", [60000, HOUR, 6 * HOUR]).withColumn("mean", F.round("mean", 4)).withColumn("se", F.round("se", 4))


@query("cancel_share", sql("""
, q AS (SELECT inst, ts, seq, floor(bid / 50) * 50 AS bid, bid_sz, floor(ask / 50) * 50 AS ask, ask_sz FROM touches),
u AS (SELECT inst, ts, seq, 'bid' AS side, bid AS px, bid_sz AS sz FROM q UNION ALL SELECT inst, ts, seq, 'ask', ask, ask_sz FROM q),
n AS (SELECT *, lead(px) OVER o AS npx, lead(sz) OVER o AS nsz FROM u WINDOW o AS (PARTITION BY inst, side ORDER BY ts, seq)), d AS (SELECT *, sz - nsz AS depleted FROM n WHERE npx = px AND nsz < sz),
h AS (SELECT inst, ts, size, floor(price / 50) * 50 AS price, CASE WHEN is_buy THEN 'ask' ELSE 'bid' END AS side FROM trades),
t AS (SELECT n.seq, n.side, sum(h.size) AS traded FROM h ASOF JOIN n ON n.inst = h.inst AND n.side = h.side AND n.ts <= h.ts WHERE abs(h.price - n.px) <= abs(n.px) * 1e-9 GROUP BY 1, 2)
SELECT inst, side, count(*) AS n, round(sum(greatest(0, depleted - coalesce(traded, 0))) / sum(depleted), 6) AS share FROM d LEFT JOIN t USING (seq, side) GROUP BY 1, 2""", "touches", "trades"))  # fmt: skip
def cancel_share(s, d):
    level = lambda c: F.floor(F.col(c) / 50) * 50.0
    return r6(T.cancel_share(V.touches(s, d).withColumn("bid", level("bid")).withColumn("ask", level("ask")), V.trades(s, d).withColumn("price", level("price")), "inst"))


@query("venue_lag", sql("""
, e AS (SELECT min(ts) // 3600000 * 3600000 AS a, max(ts) // 3600000 * 3600000 AS b FROM touches), k AS (SELECT inst, unnest(range(a, b + 1, 3600000)) AS ts FROM (SELECT DISTINCT inst FROM touches), e),
g AS (SELECT k.inst, k.ts, (t.bid + t.ask) / 2 AS mid FROM k ASOF JOIN touches t ON t.inst = k.inst AND t.ts <= k.ts WHERE k.ts - t.ts <= 43200000),
f AS (SELECT *, CASE WHEN lead(ts, 1) OVER o = ts + 3600000 THEN ln(lead(mid, 1) OVER o / mid) * 1e4 END AS f1, CASE WHEN lead(ts, 5) OVER o = ts + 18000000 THEN ln(lead(mid, 5) OVER o / mid) * 1e4 END AS f5 FROM g WHERE inst <> 0 WINDOW o AS (PARTITION BY inst ORDER BY ts)),
j AS (SELECT f.inst, ln(l.mid / f.mid) * 1e4 AS gap, unnest([1, 5]) AS ahead, unnest([f1, f5]) AS y FROM f JOIN g l ON l.ts = f.ts AND l.inst = 0)
SELECT inst, ahead, count(*) AS n, round(regr_slope(y, gap), 6) AS slope, round(CASE WHEN count(*) < 3 OR stddev_pop(y) < 1e-12 OR stddev_pop(gap) < 1e-12 THEN 0 ELSE corr(gap, y) END, 6) AS corr FROM j WHERE y IS NOT NULL GROUP BY 1, 2""", "touches"))  # fmt: skip
def venue_lag(s, d):
    q = V.touches(s, d).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    g = T.grid_asof(q, "inst", HOUR, ["mid"], 12 * HOUR).withColumnRenamed("r_mid", "mid")
    return r6(T.lag_slopes(g, "inst", 0, "mid", HOUR, [1, 5]))


# Events -------------------------------------------------------------------------------------------------------------
@query("settlement_path", sql(f"""
, {_RET}, e AS (SELECT symbol, t, CASE WHEN funding > 50 THEN 'high' WHEN funding < -50 THEN 'low' ELSE 'middle' END AS bucket FROM panel),
j AS (SELECT bucket, o AS "offset", ret FROM e, unnest([-2, -1, 0, 1, 2]) u(o) JOIN r ON r.symbol = e.symbol AND r.t = e.t + o WHERE ret IS NOT NULL)
SELECT bucket, "offset", count(*) AS n, round(avg(ret), 4) AS mean, round(stddev_samp(ret) / sqrt(count(*)), 4) AS se FROM j GROUP BY 1, 2""", "panel"))  # fmt: skip
def settlement_path(s, d):
    r = _returns(s, d)
    e = r.select("symbol", "t", F.when(F.col("funding") > 50, "high").when(F.col("funding") < -50, "low").otherwise("middle").alias("bucket"))
    return T.event_path(e, r, "symbol", "t", "ret", [-2, -1, 0, 1, 2], ["bucket"]).withColumn("mean", F.round("mean", 4)).withColumn("se", F.round("se", 4))


@query("listing_path", sql("""
, f AS (SELECT symbol, min(t) AS t0, arg_min(close, t) AS c0 FROM panel GROUP BY 1), j AS (SELECT t - t0 AS "offset", ln(close / c0) * 1e4 AS move FROM panel JOIN f USING (symbol) WHERE t - t0 BETWEEN 1 AND 6)
SELECT "offset", count(*) AS n, round(avg(move), 4) AS mean, round(stddev_samp(move) / sqrt(count(*)), 4) AS se FROM j GROUP BY 1""", "panel"))  # fmt: skip
def listing_path(s, d):
    p = V.panel(s, d)
    first = p.groupBy("symbol").agg(F.min("t").alias("t"), F.min_by("close", "t").alias("_c0"))
    moves = p.join(first.select("symbol", "_c0"), "symbol").withColumn("move", F.log(F.col("close") / F.col("_c0")) * 1e4)
    return T.event_path(first.select("symbol", "t"), moves, "symbol", "t", "move", [1, 2, 3, 4, 5, 6], []).withColumn("mean", F.round("mean", 4)).withColumn("se", F.round("se", 4))


@query("lead_lag", sql(f"""
, {_RET}, m AS (SELECT t, avg(ret) AS market FROM r WHERE ret IS NOT NULL GROUP BY 1)
SELECT r.symbol, count(*) AS n, round(CASE WHEN count(*) < 3 OR stddev_pop(market) < 1e-12 OR stddev_pop(ret) < 1e-12 THEN 0 ELSE corr(market, ret) END, 6) AS corr, round(regr_slope(ret, market), 6) AS slope FROM r JOIN m ON m.t + 1 = r.t WHERE ret IS NOT NULL GROUP BY 1""", "panel"))  # fmt: skip
def lead_lag(s, d):
    r = _returns(s, d).where("ret is not null")
    m = r.groupBy((F.col("t") + 1).alias("t")).agg(F.avg("ret").alias("market"))
    return r6(r.join(m, "t").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), T.pearson("market", "ret").alias("corr"), F.regr_slope("ret", "market").alias("slope")))


@query("cascade_rebound", sql("""
, r AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) * 1e4 AS ret FROM bars), i AS (SELECT ts, avg(ret) AS x FROM r WHERE ret IS NOT NULL GROUP BY 1),
w AS (SELECT *, CASE WHEN count(*) OVER b = 24 THEN stddev_pop(x) OVER b END AS sd, CASE WHEN count(*) OVER f = 4 THEN sum(x) OVER f END AS fwd FROM i WINDOW b AS (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), f AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
e AS (SELECT ts, fwd FROM w WHERE x <= -1.5 * sd AND fwd IS NOT NULL), n AS (SELECT ts, (SELECT min(o.ts) FROM e o WHERE o.ts > e.ts + 14400000) AS nxt FROM e),
g AS (SELECT min(ts) AS ts FROM e UNION ALL SELECT n.nxt FROM g JOIN n USING (ts) WHERE n.nxt IS NOT NULL)
SELECT count(*) AS n, round(avg(fwd), 4) AS mean FROM g JOIN e USING (ts)""", "bars").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def cascade_rebound(s, d):
    r = V.bars(s, d).withColumn("ret", W.log_return(W.ordered("symbol"), "close", 1)).where("ret is not null")
    i = r.groupBy("ts").agg(F.avg("ret").alias("x")).withColumn("index", F.lit("all"))  # one row an hour
    o = W.ordered("index")
    w = i.withColumn("sd", W.full(F.stddev_pop("x"), o, 24, -24, -1)).withColumn("fwd", W.full(F.sum("x"), o, 4, 1, 4)).where("x <= -1.5 * sd and fwd is not null")
    return sequential.non_overlapping(w, "index", 4 * HOUR).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fwd"), 4).alias("mean"))


@query("pair_reversion", sql(f"""
, {_RET}, c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS corr FROM r a JOIN r b ON a.t = b.t AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2),
p AS (SELECT symbol, partner, corr FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY corr DESC, partner) AS i FROM (SELECT a AS symbol, b AS partner, round(corr, 6) AS corr FROM c UNION ALL SELECT b, a, round(corr, 6) FROM c)) WHERE i = 1),
g AS (SELECT p.symbol, p.partner, p.corr, x.t, x.ret - y.ret AS gap FROM p JOIN r x ON x.symbol = p.symbol JOIN r y ON y.symbol = p.partner AND y.t = x.t WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)
SELECT a.symbol, a.partner, a.corr, count(*) AS n, round(avg(-sign(a.gap) * b.gap), 4) AS reverted FROM g a JOIN g b ON b.symbol = a.symbol AND b.t = a.t + 1 GROUP BY 1, 2, 3""", "panel"))  # fmt: skip
def pair_reversion(s, d):
    r = _returns(s, d).where("ret is not null").select("symbol", "t", "ret")
    g = joins.best_partners(r, "symbol", "t", "ret").join(r, "symbol").join(r.select(F.col("symbol").alias("partner"), "t", F.col("ret").alias("other")), ["partner", "t"])
    g = g.withColumn("gap", F.col("ret") - F.col("other"))
    o = joins.offset_join(g, "symbol", "t", 1, ["gap"]).where("o_gap is not null")
    return o.groupBy("symbol", "partner", "corr").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(-F.signum("gap") * F.col("o_gap")), 4).alias("reverted"))


@query("pump_fade", sql("""
, r AS (SELECT symbol, ts, ln(close / lag(close) OVER o) * 1e4 AS ret, ln(lead(close, 4) OVER o / lead(close, 1) OVER o) * 1e4 AS fwd FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
z AS (SELECT *, CASE WHEN count(*) OVER w = 24 THEN stddev_pop(ret) OVER w END AS sd FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
e AS (SELECT symbol, ts, fwd FROM z WHERE ret >= 1.5 * sd AND fwd IS NOT NULL), n AS (SELECT symbol, ts, (SELECT min(o.ts) FROM e o WHERE o.symbol = e.symbol AND o.ts > e.ts + 14400000) AS nxt FROM e),
g AS (SELECT symbol, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT n.symbol, n.nxt FROM g JOIN n USING (symbol, ts) WHERE n.nxt IS NOT NULL)
SELECT symbol, count(*) AS n, round(avg(-fwd), 4) AS short_mean FROM g JOIN e USING (symbol, ts) GROUP BY 1""", "bars").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def pump_fade(s, d):
    o = W.ordered("symbol")
    r = V.bars(s, d).withColumn("ret", W.log_return(o, "close", 1)).withColumn("fwd", F.log(F.lead("close", 4).over(o) / F.lead("close", 1).over(o)) * 1e4)
    e = r.withColumn("sd", W.full(F.stddev_pop("ret"), o, 24, -24, -1)).where("ret >= 1.5 * sd and fwd is not null").select("symbol", "ts", "fwd")
    return sequential.non_overlapping(e, "symbol", 4 * HOUR).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(-F.col("fwd")), 4).alias("short_mean"))


# Account ------------------------------------------------------------------------------------------------------------
LIMITS = {"spread_bps": 8.0, "leverage": 6.0, "order": 45.0, "cost_bps": 4.0, "position": 60.0, "notional": 80000.0, "loss": 500.0, "buffer": 0.15, "mmr": 0.005}


def _orders(s, d):
    t = V.table(s, d, "lineitem")
    side = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    return t.select("l_orderkey", "l_linenumber", side.alias("side"), F.col("l_quantity").alias("size"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (1 + F.col("l_tax") * 100).alias("leverage"), (F.col("l_discount") * 100).alias("edge_bps"), F.col("l_linenumber").cast("double").alias("spread_bps"), (F.col("l_suppkey") % 41 - 20).cast("double").alias("position"), (F.col("l_partkey") % 1200 - 600).cast("double").alias("unrealized"))


_ORDERS = """WITH o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, l_quantity AS size, l_extendedprice / l_quantity AS price, 1 + l_tax * 100 AS leverage, l_discount * 100 AS edge, l_linenumber AS spread,
  (l_suppkey % 41 - 20)::DOUBLE AS pos, (l_partkey % 1200 - 600)::DOUBLE AS unrealized FROM lineitem), a AS (SELECT *, pos + side * size AS after FROM o)"""


@query("order_reasons", f"""{_ORDERS}, x AS (SELECT *, CASE WHEN after > 0 THEN 1 - (1 - 1 / leverage) / (1 - 0.005::DOUBLE) ELSE (1 + 1 / leverage) / (1 + 0.005::DOUBLE) - 1 END AS dist FROM a)
SELECT l_orderkey, l_linenumber, CASE WHEN sign(side * size) = -sign(pos) AND size <= abs(pos) THEN '' ELSE concat_ws(',', CASE WHEN price > 0 THEN NULL ELSE 'invalid_price' END, CASE WHEN size > 0 THEN NULL ELSE 'invalid_size' END,
  CASE WHEN spread > 8 THEN 'spread' END, CASE WHEN leverage > 6 THEN 'leverage' END, CASE WHEN size > 45 THEN 'order_size' END, CASE WHEN edge <= 4 THEN 'edge' END, CASE WHEN abs(after) > 60 THEN 'position' END, CASE WHEN abs(after) * price > 80000 THEN 'notional' END,
  CASE WHEN unrealized <= -500 THEN 'unrealized_loss' END, CASE WHEN after <> 0 AND dist < 0.15::DOUBLE THEN 'liquidation' END) END AS reasons FROM x""")  # fmt: skip
def order_reasons(s, d):
    return _orders(s, d).select("l_orderkey", "l_linenumber", F.concat_ws(",", account.order_reasons(LIMITS)).alias("reasons"))


@query("position_sizes", f"""{_ORDERS}, v AS (SELECT l_orderkey, l_linenumber, 10000 * 0.01::DOUBLE / (price * greatest(spread * 20, 1) / 1e4) AS by_vol, edge / greatest(spread * 20, 1) AS b, edge, price FROM o),
k AS (SELECT *, CASE WHEN edge > 0 THEN 10000 * (least(greatest((0.9::DOUBLE * b - 0.1::DOUBLE) / b, 0), 1) * 0.25) * 3 / price ELSE 0 END AS by_kelly FROM v)
SELECT l_orderkey, l_linenumber, round(least(by_vol, by_kelly, 2), 6) AS size, CASE WHEN by_kelly = least(by_vol, by_kelly, 2) THEN 'kelly' WHEN by_vol = least(by_vol, by_kelly, 2) THEN 'volatility' ELSE 'cap' END AS bound FROM k""")  # fmt: skip
def position_sizes(s, d):
    o = _orders(s, d)
    size, bound = account.position_size(F.lit(10000.0), 0.01, F.col("price"), F.col("spread_bps") * 20, F.nullif(F.col("edge_bps"), F.lit(0.0)), 0.9, 0.25, 3.0, F.lit(2.0))
    return o.select("l_orderkey", "l_linenumber", F.round(size, 6).alias("size"), bound.alias("bound"))


_SIDES = f""", {_RET}, v AS (SELECT symbol, t, CASE WHEN funding > 0 THEN 'long' ELSE 'short' END AS side, 10 + round(abs(ret), 2) AS risk FROM r WHERE ret IS NOT NULL)"""


@query("side_weights", sql(f"""
{_SIDES}, w AS (SELECT *, 1 / risk AS raw, count(*) OVER s AS n, greatest(0.25, 1.0::DOUBLE / count(*) OVER s) AS cap FROM v WINDOW s AS (PARTITION BY t, side)),
i AS (SELECT *, row_number() OVER (PARTITION BY t, side ORDER BY raw DESC, symbol) - 1 AS i, sum(raw) OVER (PARTITION BY t, side ORDER BY raw DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
k AS (SELECT *, coalesce(min(i) FILTER (WHERE NOT raw / rest * (1 - i * cap) > cap * (1 + 1e-9)) OVER (PARTITION BY t, side), n) AS k FROM i),
f AS (SELECT *, sum(raw) FILTER (WHERE i >= k) OVER (PARTITION BY t, side) AS free FROM k)
SELECT t, side, symbol, i < k AS capped, round(CASE WHEN i < k THEN cap ELSE raw / free * (1 - k * cap) END, 6) AS weight FROM f""", "panel"))  # fmt: skip
def side_weights(s, d):
    v = _returns(s, d).where("ret is not null").select("symbol", "t", F.when(F.col("funding") > 0, "long").otherwise("short").alias("side"), (10 + F.round(F.abs("ret"), 2)).alias("risk"))
    return r6(account.side_weights(v, ["t", "side"], "symbol", "risk", 0.25).select("t", "side", "symbol", "capped", "weight"))


def _books(s, d):
    b = X.book(_scored(s, d), "blend")
    return b, b.withColumn("t", F.col("t") + 1)


@query("interleaved_orders", sql(f"""
, {_FACT}, {_BOOK.format(more='')}, mv AS (SELECT coalesce(n.t, p.t) AS t, coalesce(n.symbol, p.symbol) AS symbol, round((coalesce(n.weight, 0) - coalesce(p.weight, 0)) * 1e9::DOUBLE) AS move FROM b n FULL JOIN (SELECT t + 1 AS t, symbol, weight FROM b) p ON n.t = p.t AND n.symbol = p.symbol),
od AS (SELECT t, symbol, CASE WHEN move > 0 THEN 'buy' ELSE 'sell' END AS side, abs(move) AS notional, row_number() OVER (PARTITION BY t, move > 0 ORDER BY abs(move) DESC, symbol) AS r FROM mv WHERE move <> 0),
ct AS (SELECT t, count(*) FILTER (side = 'buy') AS nb, count(*) FILTER (side = 'sell') AS ns FROM od GROUP BY 1),
st AS (SELECT t, 0::BIGINT AS i, 0::BIGINT AS j, 0.0::DOUBLE AS net, NULL::BIGINT AS symbol, NULL::VARCHAR AS side, NULL::DOUBLE AS notional FROM ct UNION ALL
  SELECT st.t, i + (od.side = 'buy')::BIGINT, j + (od.side = 'sell')::BIGINT, net + CASE WHEN od.side = 'buy' THEN od.notional ELSE -od.notional END, od.symbol, od.side, od.notional FROM st JOIN ct USING (t)
  JOIN od ON od.t = st.t AND od.side = CASE WHEN j = ns OR (i < nb AND net <= 0) THEN 'buy' ELSE 'sell' END AND od.r = CASE WHEN od.side = 'buy' THEN i ELSE j END + 1 WHERE i + j < nb + ns)
SELECT t, i + j - 1 AS place, symbol, side, round(notional / 1e9::DOUBLE, 6) AS notional, round(net / 1e9::DOUBLE, 6) + 0.0::DOUBLE AS net_after FROM st WHERE symbol IS NOT NULL""", "panel").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def interleaved_orders(s, d):
    """Weights in whole billionths, so that sums are exact and a net of nothing is 0."""
    now, was = _books(s, d)
    j = now.select("t", "symbol", F.col("weight").alias("w")).join(was.select("t", "symbol", F.col("weight").alias("v")), ["t", "symbol"], "full").fillna(0.0, ["w", "v"]).withColumn("move", F.round((F.col("w") - F.col("v")) * 1e9)).where("move <> 0")
    o = account.interleaved(j.select("t", "symbol", F.when(F.col("move") > 0, "buy").otherwise("sell").alias("side"), F.abs("move").alias("notional")), "t", "symbol")
    return r6(o.withColumns({"notional": F.col("notional") / 1e9, "net_after": F.col("net_after") / 1e9}))


@query("leg_changes", sql(f", {_FACT}, {_BOOK.format(more='')}, p AS (SELECT t + 1 AS t, symbol FROM b) SELECT t, symbol, 'gone' AS change FROM p ANTI JOIN b USING (t, symbol) UNION ALL SELECT t, symbol, 'new' FROM b ANTI JOIN p USING (t, symbol)", "panel"))
def leg_changes(s, d):
    now, was = _books(s, d)
    return account.leg_changes(was, now, ["t", "symbol"])


@query("run_states", sql("""
, e AS (SELECT max(ts) AS now FROM ticks), g AS (SELECT inst, max(ts) AS last, count(*) AS n, arg_max(event_type, (ts, seq)) AS event FROM ticks GROUP BY 1)
SELECT inst, n, last, CASE WHEN event = 'error' THEN 'stopped' WHEN now - last > 3600000 THEN 'silent' ELSE 'running' END AS state FROM g, e""", "ticks"))  # fmt: skip
def run_states(s, d):
    t = V.ticks(s, d)
    g = t.groupBy("inst").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.max_by("event_type", F.struct("ts", "seq")).alias("event"))
    state = F.when(F.col("event") == "error", "stopped").when(F.col("now") - F.col("last") > HOUR, "silent").otherwise("running")
    return g.join(F.broadcast(t.agg(F.max("ts").alias("now")))).select("inst", "n", "last", state.alias("state"))


@query("ranked_carry", sql("""
, p AS (SELECT symbol, avg(funding) AS carry, count(*) AS n, sum(volume) AS volume FROM panel GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY abs(round(carry, 6)) DESC, symbol)::INT AS place FROM p)
SELECT symbol, round(carry, 6) AS carry, n, round(volume, 2) AS volume, place FROM k WHERE place <= 10""", "panel"))  # fmt: skip
def ranked_carry(s, d):
    p = V.panel(s, d).groupBy("symbol").agg(V.rounded(F.avg("funding")).alias("carry"), F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"))
    top = p.orderBy(F.desc(F.abs("carry")), "symbol").limit(10)  # the report is a top ten
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("carry")), "symbol")))


@query("logistic")
def logistic(s, d):
    rows = _xy(s, d).where("y is not null").select((F.col("funding") / 100).alias("funding"), "taker", (F.col("y") > 0).cast("double").alias("up"))
    return r6(S.logistic(rows, ["funding", "taker"], "up", 1.0))


@query("coverage", sql(", d AS (SELECT DISTINCT symbol, ts // 86400000 AS d FROM funding), e AS (SELECT max(d) - min(d) + 1 AS expected FROM d) SELECT symbol, count(*) AS days, any_value(expected) AS expected, round(count(*) / any_value(expected), 6) AS share FROM d, e GROUP BY 1", "funding"))
def coverage(s, d):
    return r6(sinks.coverage(V.funding(s, d), "symbol", "ts"))


@query("whole_cross_sections", sql(", f AS (SELECT symbol, ts, range_pos FROM (SELECT symbol, ts, CASE WHEN count(*) OVER w = 12 THEN CASE WHEN max(high) OVER w > min(low) OVER w THEN (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) ELSE 0.5 END END AS range_pos FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE range_pos IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM f) SELECT symbol, ts, round(range_pos, 6) AS range_pos FROM n WHERE n >= 3", "bars"))
def whole_cross_sections(s, d):
    f = V.bars(s, d).select("symbol", "ts", W.range_position(W.ordered("symbol"), "close", "high", "low", 12).alias("range_pos"))
    return r6(sinks.whole_cross_sections(f, "ts", ["range_pos"], 3))


@query("tranche_book", sql(f"""
, {_FACT}, {_BOOK.format(more='')}, h AS (SELECT t + k AS t, symbol, weight FROM b, (SELECT unnest(range(0, 3)) AS k)), e AS (SELECT min(t) + 2 AS a, max(t) AS z FROM b)
SELECT t, symbol, round(sum(weight) / 3, 6) AS weight FROM h, e WHERE t BETWEEN a AND z GROUP BY 1, 2""", "panel"))  # fmt: skip
def tranche_book(s, d):
    return r6(T.tranche_book(X.book(_scored(s, d), "blend"), "t", "symbol", 3))


@query("regime_terciles", sql(f"""
, {_RET}, m AS (SELECT t, round(avg(ret), 6) AS market FROM r WHERE ret IS NOT NULL GROUP BY 1), n AS (SELECT market, lead(market) OVER (ORDER BY t) AS nxt FROM m), c AS (SELECT quantile_cont(market, 1.0::DOUBLE / 3) AS p, quantile_cont(market, 2.0::DOUBLE / 3) AS q FROM n)
SELECT CASE WHEN market <= p THEN 'low' WHEN market <= q THEN 'middle' ELSE 'high' END AS third, count(*) AS n, round(avg(nxt), 4) AS mean, round(stddev_samp(nxt) / sqrt(count(*)), 4) AS se FROM n, c WHERE nxt IS NOT NULL GROUP BY 1""", "panel"))  # fmt: skip
def regime_terciles(s, d):
    m = _returns(s, d).where("ret is not null").groupBy("t").agg(V.rounded(F.avg("ret")).alias("market"))  # one row a time
    m = m.withColumn("next", F.lead("market").over(Window.partitionBy(F.lit(0)).orderBy("t")))
    return T.by_tercile(m, "market", "next").withColumn("mean", F.round("mean", 4)).withColumn("se", F.round("se", 4))


@query("paired_legs", """
SELECT c.tag, c.c_name AS perp_name, round(c.c_acctbal, 2) AS perp_balance, s.s_name AS spot_name, round(s.s_acctbal, 2) AS spot_balance FROM (SELECT *, regexp_extract(c_name, '#0*([0-9]+)', 1) AS tag FROM customer) c
JOIN (SELECT *, regexp_extract(s_name, '#0*([0-9]+)', 1) AS tag FROM supplier) s USING (tag) WHERE tag <> ''""")  # fmt: skip
def paired_legs(s, d):
    c = V.table(s, d, "customer").select(F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))
    p = V.table(s, d, "supplier").select(F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"))
    return account.paired_legs(c, p, "name", "#0*([0-9]+)")


@query("funding_whole_days", sql("SELECT symbol, (ts - 1) // 86400000 AS day, round(CASE WHEN count(*) >= 2 THEN sum(bps) END, 6) AS bps, count(*) AS periods FROM funding GROUP BY 1, 2", "funding"))
def funding_whole_days(s, d):
    return r6(account.whole_days(V.funding(s, d), "symbol", "ts", "bps", 3))


@query("scalar_functions", sql("""
SELECT seq, upper(event_type) AS coin, replace(event_type || '-USDT', '-', '') AS joined, ((ts // 86400000 + 3) % 7)::BIGINT AS weekday, ((ts // 3600000) % 24)::BIGINT AS hour, CASE WHEN price >= 100 THEN 1 WHEN price <= -100 THEN -1 ELSE 0 END::INT AS label,
       round(CASE WHEN size <= 2 THEN 1.0 WHEN size <= 5 THEN 1 + (size - 2) / 3 * 2 WHEN size <= 9 THEN 3 + (size - 5) / 4 * 4 ELSE 7 END, 6) AS skill, round(CASE WHEN price <= 0 THEN 0 ELSE ln(price / size) * 1e4 END, 6) AS ret FROM ticks""", "ticks"))  # fmt: skip
def scalar_functions(s, d):
    t = V.ticks(s, d)
    name = F.concat(F.lit("1000"), "event_type", F.lit("-USDT"))
    return r6(t.select("seq", M.canonical_coin(name).alias("coin"), M.joined_symbol(F.concat("event_type", F.lit("-USDT"))).alias("joined"), M.weekday("ts").cast("long").alias("weekday"), M.hour("ts").cast("long").alias("hour"), M.ternary("price", 100.0).alias("label"), M.interpolate("size", [2.0, 5.0, 9.0], [1.0, 3.0, 7.0]).alias("skill"), M.log_return_bps("price", "size").alias("ret")))

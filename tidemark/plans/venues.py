"""Queries of the venue operators: listings, screens, candles, fees, depth, a leader's lead, books side by side, premiums, a made-up path."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import studies
from tidemark.operators import venues as N
from tidemark.plans.registry import _RET, DAY, HOUR, _returns, query, r6
from tidemark.sources import views as V
from tidemark.sources.views import sql


def _titles(s, d):
    p = V.table(s, d, "part").withColumn("a", F.concat(F.lit("T"), "p_partkey"))
    spot = F.concat(F.lit("Binance Will List "), "p_name", F.lit(" ("), "a", F.lit(") and More ("), "a", F.lit("X)"))
    futures = F.concat(F.lit("BINANCE futures will launch "), "a", F.lit("USDT and USDUSDT Contracts, Binance Will List (Q)"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, futures).when(F.col("p_partkey") % 4 == 1, spot).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Alpha: "), spot)).otherwise(F.col("p_name")).alias("title"))


@query("listings", """
WITH p AS (SELECT p_partkey, p_partkey % 4 AS m, 'T' || p_partkey AS a FROM part),
l AS (SELECT p_partkey, 'futures' AS kind, a AS ticker FROM p WHERE m = 0 UNION ALL SELECT p_partkey, 'spot', unnest([a, a || 'X']) FROM p WHERE m = 1),
i AS (SELECT a || '-USDT' AS inst_id FROM p WHERE p_partkey % 3 = 0 UNION ALL SELECT '1000' || a || '-USDT' FROM p WHERE p_partkey % 5 = 0 UNION ALL SELECT '10000' || a || '-USDT' FROM p WHERE p_partkey % 7 = 0)
SELECT p_partkey, kind, ticker, coalesce(a.inst_id, b.inst_id, c.inst_id) AS inst_id FROM l
LEFT JOIN i a ON a.inst_id = ticker || '-USDT' LEFT JOIN i b ON b.inst_id = '1000' || ticker || '-USDT' LEFT JOIN i c ON c.inst_id = '10000' || ticker || '-USDT'""")  # fmt: skip
def listings(s, d):
    p = V.table(s, d, "part")
    name = lambda m, by: p.where(F.col("p_partkey") % by == 0).select(F.concat(F.lit(f"{m}T"), "p_partkey", F.lit("-USDT")).alias("inst_id"))
    return N.traded_as(N.announced(_titles(s, d), "title").drop("title"), "ticker", name("", 3).union(name("1000", 5)).union(name("10000", 7))).select("p_partkey", "kind", "ticker", "inst_id")


@query("instrument_screen", """
WITH i AS (SELECT p_partkey || '-USDT' AS inst_id, p_size / 100 AS tick, CASE WHEN p_partkey % 3 > 0 THEN 1 + p_partkey % 3 END::DOUBLE AS contract, CASE WHEN p_partkey % 11 = 0 THEN 'suspend' ELSE 'live' END AS state FROM part),
t AS (SELECT l_partkey || CASE WHEN l_partkey % 13 = 0 THEN '-USDC' ELSE '-USDT' END AS inst_id, l_partkey, max(l_extendedprice / l_quantity) AS last, min(l_extendedprice / l_quantity) * 0.999 AS bid, max(l_extendedprice / l_quantity) * (l_partkey % 7 > 0)::INT AS ask, sum(l_quantity) AS volume FROM lineitem GROUP BY 2, 1),
g AS (SELECT (o_custkey % 200) || 'USDT' AS symbol, sum(o_totalprice) AS lead_volume FROM orders GROUP BY 1),
x AS (SELECT inst_id, last AS price, tick / last * 1e4 AS tick_bps, CASE WHEN bid > 0 AND ask > 0 THEN (ask - bid) / ((ask + bid) / 2) * 1e4 END AS spread_bps, CASE WHEN bid > 0 AND ask > 0 THEN (ask - bid) / tick END AS spread_ticks,
  volume * coalesce(contract, 1) * last AS value, lead_volume, state FROM t JOIN i USING (inst_id) LEFT JOIN g ON g.symbol = replace(inst_id, '-', '') WHERE inst_id LIKE '%-USDT' AND last > 0)
SELECT inst_id, round(price + 1e-9, 6) AS price, round(tick_bps + 1e-9, 6) AS tick_bps, round(spread_bps + 1e-9, 6) AS spread_bps, round(spread_ticks + 1e-9, 6) AS spread_ticks, round(value / 1e6::DOUBLE + 1e-9, 6) AS value, round(lead_volume / 1e6::DOUBLE + 1e-9, 6) AS lead_volume,
  concat_ws(',', CASE WHEN state <> 'live' THEN 'not live' END, CASE WHEN tick_bps > 4 THEN 'coarse tick' END, CASE WHEN tick_bps < 0.5 THEN 'fine tick' END, CASE WHEN NOT coalesce(spread_ticks >= 3, false) THEN 'narrow' END,
    CASE WHEN value < 500000 THEN 'thin' END, CASE WHEN lead_volume IS NULL THEN 'no leader' END, CASE WHEN lead_volume < 2000000 THEN 'thin leader' END) AS reasons FROM x""")  # fmt: skip
def instrument_screen(s, d):
    k = F.col("p_partkey")
    i = V.table(s, d, "part").select(F.concat(k, F.lit("-USDT")).alias("inst_id"), (F.col("p_size") / 100).alias("tick"), F.when(k % 3 > 0, 1 + k % 3).cast("double").alias("contract"), F.when(k % 11 == 0, "suspend").otherwise("live").alias("state"))
    unit, k = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_partkey")
    t = V.table(s, d, "lineitem").groupBy("l_partkey").agg(F.max(unit).alias("last"), (F.min(unit) * 0.999).alias("bid"), F.max(unit).alias("ask"), F.sum("l_quantity").alias("volume"))
    t = t.withColumn("ask", F.col("ask") * (k % 7 > 0).cast("int")).withColumn("inst_id", F.concat(k, F.when(k % 13 == 0, "-USDC").otherwise("-USDT")))
    g = V.table(s, d, "orders").groupBy(F.concat(F.col("o_custkey") % 200, F.lit("USDT")).alias("symbol")).agg(F.sum("o_totalprice").alias("lead_volume"))
    x = N.screen(i, t, g, 500_000, 2_000_000, 4.0, 0.5, 3.0)
    return r6(x.withColumns({"reasons": F.concat_ws(",", "reasons"), "value": F.col("value") / 1e6, "lead_volume": F.col("lead_volume") / 1e6}))


@query("candles", sql("SELECT symbol, ts, open::DECIMAL(28,10)::DOUBLE AS open, high::DECIMAL(28,10)::DOUBLE AS high, low::DECIMAL(28,10)::DOUBLE AS low, CASE WHEN n % 5 = 0 AND ts // 3600000 % 2 = 0 THEN 0 ELSE close::DECIMAL(28,10)::DOUBLE END AS close FROM bars", "bars"))
def candles(s, d):
    b = V.bars(s, d)
    cell = [F.col(c).cast("string") for c in ("ts", "open", "high", "low", "close")]
    names = ("ts", "open", "high", "low", "close")
    known = F.when(F.col("n") % 5 == 0, F.to_json(F.struct(*[c.alias(n) for c, n in zip(cell[:4], names, strict=False)]))).otherwise(F.to_json(F.struct(*[c.alias(n) for c, n in zip(cell, names, strict=True)])))
    t = b.select("symbol", F.when(F.col("ts") / HOUR % 2 == 0, known).otherwise(F.to_json(F.array(*cell))).alias("text"))
    c = N.candle("text")
    return t.select("symbol", c["ts"].alias("ts"), *[c[n].cast("double").alias(n) for n in names[1:]])


@query("fee_ladder", "SELECT * FROM (VALUES (0, 2.0::DOUBLE, 6.0::DOUBLE, 'sound'), (1, 0.6, 5.0, 'sound'), (2, 0.4, 4.5, 'sound'), (3, 0.2, 4.25, 'sound'), (5, 0.0, 3.5, 'sound')) t(tier, maker_bps, taker_bps, fault)")
def fee_ladder(s, d):
    f = N.fee_schedule(s)
    return f.join(N.ladder_faults(f).select("tier", "fault"), "tier", "left").fillna("sound", ["fault"])


_DAYS = "d AS (SELECT inst AS symbol, ts // 86400000 AS day, arg_max(price, (ts, seq)) AS close, count(*) AS n FROM ticks GROUP BY 1, 2), f AS (SELECT symbol, ts // 86400000 AS day, sum(bps) AS funding, count(*) AS periods FROM funding WHERE symbol < 8 GROUP BY 1, 2)"


@query("days_with_funding", sql(f", {_DAYS} SELECT d.symbol, d.day, close, n, round(funding, 4) AS funding, coalesce(periods, 0) AS periods FROM d LEFT JOIN f ON f.symbol = d.symbol AND f.day = d.day - 10000", "ticks", "funding"))
def days_with_funding(s, d):
    day = F.floor(F.col("ts") / DAY).alias("day")
    days = V.ticks(s, d).groupBy(F.col("inst").alias("symbol"), day).agg(F.max_by("price", F.struct("ts", "seq")).alias("close"), F.count(F.lit(1)).alias("n"))
    f = V.funding(s, d).groupBy("symbol", day).agg(F.sum("bps").alias("funding"), F.count(F.lit(1)).alias("periods")).withColumn("day", F.col("day") + 10000)
    return N.with_funding(days, f, ["symbol", "day"]).withColumn("funding", F.round("funding", 4))


@query("time_order", sql("""
, r AS (SELECT inst, seq, ts, coalesce(max(ts) OVER (PARTITION BY inst ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts, false) AS late, row_number() OVER (PARTITION BY inst ORDER BY ts, seq) AS place FROM ticks)
SELECT inst, count(*) AS n, count(*) FILTER (late) AS late, sum(place * seq)::BIGINT AS places FROM r GROUP BY 1""", "ticks"))  # fmt: skip
def time_order(s, d):
    t = N.time_order(V.ticks(s, d), "inst", "seq", "ts")
    return t.groupBy("inst").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("late").cast("long")).alias("late"), F.sum(F.col("place") * F.col("seq")).alias("places"))


@query("depth_state", sql("""
, p AS (SELECT inst, ts, arg_max(bid_sz, seq) AS b, arg_max(ask_sz, seq) AS a FROM touches GROUP BY 1, 2),
j AS (SELECT t.inst, t.ts, t.seq, p.ts AS seen, b, a, ln(4 * b + 3 * a) AS l FROM trades t ASOF JOIN p ON t.inst = p.inst AND t.ts >= p.ts WHERE 4 * b + 3 * a > 0)
SELECT inst, ts, seq, round((ts - seen) / 1000, 6) AS depth_age_s, round((b - a) / (b + a), 6) AS depth_imb_0p2, round((3 * b - 2 * a) / (3 * b + 2 * a), 6) AS depth_imb_1,
  round(coalesce(l - median(l) OVER (PARTITION BY inst ORDER BY ts, seq ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 0), 6) AS depth_total_ln FROM j""", "touches", "trades"))  # fmt: skip
def depth_state(s, d):
    b, a = F.col("bid_sz"), F.col("ask_sz")
    t = V.touches(s, d).select("inst", "ts", "seq", b.alias("neg_0p2"), a.alias("pos_0p2"), (3 * b).alias("neg_1"), (2 * a).alias("pos_1"))
    return r6(N.depth_state(V.trades(s, d).select("inst", "ts", "seq"), t, "inst", ("0p2", "1")))


_TRADES = """
, m AS (SELECT inst, ts, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask FROM touches GROUP BY 1, 2),
e AS (SELECT min(ts) // 3600000 * 3600000 AS a, max(ts) // 3600000 * 3600000 AS b FROM touches),
g0 AS (SELECT inst, unnest(range(a, b + 1, 3600000)) AS ts FROM (SELECT DISTINCT inst FROM touches), e),
g AS (SELECT g0.inst, g0.ts, bid, ask FROM g0 ASOF JOIN m ON g0.inst = m.inst AND g0.ts >= m.ts WHERE g0.ts - m.ts <= 7200000),
f AS (SELECT g.inst, g.ts, g.bid, g.ask, x.bid AS xb, x.ask AS xa, (l.bid + l.ask) / 2 AS lead FROM g JOIN g x ON x.inst = g.inst AND x.ts = g.ts + 10800000 JOIN g l ON l.inst = 0 AND l.ts = g.ts WHERE g.inst <> 0),
c AS (SELECT *, CASE WHEN lead > ask * 1.0007 THEN 1 WHEN lead < bid * 0.9993 THEN -1 END AS side FROM f), h AS (SELECT * FROM c WHERE side IS NOT NULL),
nx AS (SELECT p.inst, p.ts, min(q.ts) AS nxt FROM h p LEFT JOIN h q ON q.inst = p.inst AND q.ts >= p.ts + 10800000 GROUP BY 1, 2),
k AS (SELECT inst, min(ts) AS ts FROM h GROUP BY 1 UNION ALL SELECT nx.inst, nx.nxt FROM k JOIN nx USING (inst, ts) WHERE nxt IS NOT NULL)
SELECT inst, ts, side, round(entry, 6) AS entry, round(side * ((xb + xa) / 2 - entry) / entry * 1e4 - 12, 6) AS net_mid, round(side * (CASE WHEN side > 0 THEN xb ELSE xa END - entry) / entry * 1e4 - 12, 6) AS net_touch
FROM (SELECT h.*, CASE WHEN side > 0 THEN ask ELSE bid END AS entry FROM h JOIN k USING (inst, ts))"""


def _touch_grid(s, d):
    return studies.grid_asof(V.touches(s, d), "inst", HOUR, ["bid", "ask"], 2 * HOUR).select("inst", "ts", F.col("r_bid").alias("bid"), F.col("r_ask").alias("ask"))


@query("lead_trades", sql(_TRADES, "touches").replace("WITH", "WITH RECURSIVE", 1))
def lead_trades(s, d):
    return r6(N.lead_trades(_touch_grid(s, d), "inst", 0, 3 * HOUR, 6.0, 1.0))


_STACK = """, v AS (SELECT symbol % 2 AS venue, t, avg(ret) AS net FROM r WHERE ret IS NOT NULL AND t >= 23906 AND (t - 23906) % 2 = 0 GROUP BY 1, 2),
p AS (SELECT a.t, a.net AS even, b.net AS odd, (a.net + b.net) / 2 AS stack FROM v a JOIN v b ON a.venue = 0 AND b.venue = 1 AND a.t = b.t)"""


def _stack(s, d):
    m = N.aligned(_returns(s, d).where("ret is not null"), "t", 23906, 2).groupBy((F.col("symbol") % 2).alias("venue"), "t").agg(F.avg("ret").alias("net"))
    return N.period_stack({"even": m.where("venue = 0"), "odd": m.where("venue = 1")}, "t", "net")


@query("period_stack", sql(f", {_RET}{_STACK} SELECT t, round(even, 6) AS even, round(odd, 6) AS odd, round(stack, 6) AS stack FROM p", "panel"))
def period_stack(s, d):
    return r6(_stack(s, d))


@query("stack_summary", sql(f"""
, {_RET}{_STACK}, l AS (SELECT 'even' AS book, even AS x, stack FROM p UNION ALL SELECT 'odd', odd, stack FROM p UNION ALL SELECT 'stack', stack, stack FROM p)
SELECT book, count(*) AS periods, round(avg(x), 6) AS mean, round(avg(x) / stddev_samp(x) * sqrt(6), 6) AS sharpe, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS worst, round(corr(x, stack), 6) AS with_stack FROM l GROUP BY 1""", "panel"))  # fmt: skip
def stack_summary(s, d):
    return r6(N.stack_summary(_stack(s, d), ["even", "odd"], 6.0))


_PREMIUM = """, q AS (SELECT *, round((taker - 0.25) * 40, 6) AS premium FROM panel), g AS (SELECT *, CASE WHEN count(premium) OVER a >= 2 * 0.8 THEN avg(premium) OVER a END AS s, CASE WHEN count(premium) OVER b >= 6 * 0.8 THEN avg(premium) OVER b END AS w,
  row_number() OVER o AS n FROM q WINDOW o AS (PARTITION BY symbol ORDER BY t), a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN n > 2 THEN s END AS short, CASE WHEN n > 6 THEN w END AS long FROM g)"""


def _premiums(s, d):
    p = V.panel(s, d).withColumn("premium", V.rounded((F.col("taker") - 0.25) * 40))
    return N.premium_factors(p, "symbol", "t", "premium", 2, 6)


@query("premium_factors", sql(f"{_PREMIUM} SELECT symbol, t, round(-premium, 6) AS prem_now, round(-short, 6) AS prem_short, round(-long, 6) AS prem_long, round(-(short - long), 6) AS prem_chg FROM f", "panel"))
def premium_factors(s, d):
    return r6(_premiums(s, d).select("symbol", "t", "prem_now", "prem_short", "prem_long", "prem_chg"))


@query("premium_tails", sql(f"""{_PREMIUM},
o AS (SELECT *, CASE WHEN lead(t, 2) OVER o = t + 2 THEN ln(lead(close, 2) OVER o / close) * 1e4 END AS fwd, coalesce(sum(funding) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS paid FROM f WINDOW o AS (PARTITION BY symbol ORDER BY t)),
x AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY t) AS ex FROM o),
h AS (SELECT 'above' AS tail, * FROM x WHERE ex IS NOT NULL AND round(short, 6) > 3 UNION ALL SELECT 'below', * FROM x WHERE ex IS NOT NULL AND round(short, 6) < -3),
nx AS (SELECT p.tail, p.symbol, p.t, min(q.t) AS nxt FROM h p LEFT JOIN h q ON q.tail = p.tail AND q.symbol = p.symbol AND q.t > p.t + 2 GROUP BY 1, 2, 3),
k AS (SELECT tail, symbol, min(t) AS t FROM h GROUP BY 1, 2 UNION ALL SELECT nx.tail, nx.symbol, nx.nxt FROM k JOIN nx USING (tail, symbol, t) WHERE nxt IS NOT NULL),
e AS (SELECT h.*, ex - paid - 8 AS net FROM h JOIN k USING (tail, symbol, t)), pm AS (SELECT tail, t // 2 AS p, avg(net) AS m FROM e GROUP BY 1, 2), se AS (SELECT tail, stddev_samp(m) / sqrt(count(*)) AS se FROM pm GROUP BY 1)
SELECT tail, count(*) AS events, count(DISTINCT symbol) AS names, round(avg(net), 6) AS net, round(avg(paid), 6) AS paid, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS gained, round(any_value(se.se), 6) AS se FROM e JOIN se USING (tail) GROUP BY 1""", "panel").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def premium_tails(s, d):
    p = _premiums(s, d).withColumn("short", V.rounded(-F.col("prem_short")))
    return r6(N.premium_tails(p, "symbol", "t", "close", "funding", "short", 3.0, 2, 4.0))


@query("aligned_scores", sql(f", {_RET}, y AS (SELECT symbol, t, round(ret, 6) AS ret, round(-funding, 6) AS x FROM r WHERE ret IS NOT NULL) SELECT symbol, count(*) AS rows, round(CASE WHEN stddev_pop(ret) > 0 AND stddev_pop(x) > 0 THEN corr(x, ret) END, 6) AS ic FROM y GROUP BY 1", "panel"))
def aligned_scores(s, d):
    r = _returns(s, d).where("ret is not null").select("symbol", "t", V.rounded(F.col("ret")).alias("ret"), (-F.col("funding")).alias("prediction"))
    return r6(N.aligned_scores(r.select("symbol", "t", "ret"), r.select("symbol", "t", "prediction"), "symbol", "t", "ret"))


#: Two days of a path of six steps a minute with a half-life of six hours.
_OU = f"""
WITH RECURSIVE c AS (SELECT 1 - ln(2) / (6 / 24.0::DOUBLE) / 8640 AS d),
s AS (SELECT i, i // 360 AS h, i % 360 AS j, md5('7:' || i) AS m FROM range(17280) r(i)),
z AS (SELECT i, h, j, sqrt(-2 * ln((('0x' || m[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)) * cos({2 * math.pi!r}::DOUBLE * (('0x' || m[9:16])::BIGINT + 0.5::DOUBLE) / 4294967296) * 0.03 * sqrt(1 / 8640.0::DOUBLE) AS z FROM s),
x AS (SELECT i, h, j, sum(z / d ** j) OVER (PARTITION BY h ORDER BY j) * d ** j AS x FROM z, c),
l AS (SELECT 0::BIGINT AS h, 0.0::DOUBLE AS f UNION ALL SELECT l.h + 1, f * d ** 360 + x.x FROM l, x, c WHERE x.h = l.h AND x.j = 359 AND l.h < 47),
p AS (SELECT i, 100 * exp(x + f * d ** (j + 1)) AS price FROM x JOIN l USING (h), c)
SELECT 1700000000000 + i // 6 * 60000 AS ts, round(arg_min(price, i) + 1e-9, 6) AS open, round(max(price) + 1e-9, 6) AS high, round(min(price) + 1e-9, 6) AS low, round(arg_max(price, i) + 1e-9, 6) AS close FROM p GROUP BY 1"""


@query("made_up_path", _OU)
def made_up_path(s, d):
    return r6(N.ou_bars(s, 2, 6.0, seed=7, sub_steps=6))

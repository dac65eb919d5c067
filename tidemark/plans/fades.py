"""Queries of range fades: one setting, a grid with a control, gated entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ieee import ln
from tidemark.operators import fades as E
from tidemark.operators import sequential
from tidemark.plans.registry import DAY, HOUR, query, r6
from tidemark.sources import views as V
from tidemark.sources.views import sql

_TRADE = "symbol, entry_ts, exit_ts, side, round(entry, 6) AS entry, round(exit, 6) AS exit, reason, round(net_bps, 6) AS net_bps"


def _fade_sql(bars: str, runs: list[E.Fade], costs: E.Costs, tail: str, leverage: float | None = None, step: int | None = None, allow: str = "true") -> str:
    """Each entry's exit by a join on the bars of its hold; the chain of trades by recursion. bars has (symbol, ts, open, high, low, close)."""
    rows = ", ".join(f"('{r.name}', {r.look}, {r.hold}, {r.entry}::DOUBLE, {r.stop}::DOUBLE, {r.target}::DOUBLE, {r.least_width_bps}::DOUBLE, {r.most_trend if r.most_trend is not None else 'NULL'}::DOUBLE)" for r in runs)
    whole = f"ts - lag(ts, look) OVER o = look * {step}" if step else "true"
    liq = f"CASE WHEN side > 0 THEN least(fill * (1 - 1 / {leverage}::DOUBLE) / 0.995, fill) ELSE greatest(fill * (1 + 1 / {leverage}::DOUBLE) / 1.005, fill) END" if leverage else "NULL::DOUBLE"
    margin = 1e4 / leverage if leverage else 0
    past = f"{costs.through}::DOUBLE / 1e4"
    return f"""
, runs(run, look, hold, entry, stop, target, least, most) AS (VALUES {rows}),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ({bars})),
w AS (SELECT n.*, runs.*, CASE WHEN i > look AND {whole} THEN max(high) OVER f END AS hi, min(low) OVER f AS lo, abs(lag(close) OVER o - lag(close, look) OVER o) AS trend FROM n, runs
  WINDOW o AS (PARTITION BY run, symbol ORDER BY ts), f AS (PARTITION BY run, symbol ORDER BY ts ROWS BETWEEN look PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, hi - lo AS width, lo + entry * (hi - lo) AS buy, hi - entry * (hi - lo) AS sell FROM w WHERE hi > lo AND (hi - lo) / ((hi + lo) / 2) * 1e4 >= least AND (most IS NULL OR trend / (hi - lo) <= most) AND {allow}),
u AS (SELECT *, open > buy AND low <= buy * (1 - {past}) AS up, open < sell AND high >= sell * (1 + {past}) AS down FROM g),
c0 AS (SELECT run, symbol, i, ts, hold, CASE WHEN up THEN 1 ELSE -1 END AS side, CASE WHEN up THEN buy ELSE sell END AS fill, CASE WHEN up THEN lo - stop * width ELSE hi + stop * width END AS st, CASE WHEN up THEN lo + target * width ELSE hi - target * width END AS tg FROM u WHERE up <> down),
c1 AS (SELECT *, {liq} AS liq FROM c0), c AS (SELECT * FROM c1 WHERE liq IS NULL OR side * (st - liq) > 0),
j AS (SELECT c.*, n.i AS j, n.ts AS jts, n.open AS o, n.close AS cl, CASE WHEN side > 0 THEN n.low ELSE n.high END AS worst, CASE WHEN side > 0 THEN n.high ELSE n.low END AS best FROM c JOIN n ON n.symbol = c.symbol AND n.i BETWEEN c.i AND c.i + c.hold),
k AS (SELECT *, CASE WHEN j > i AND side * (o - st) <= 0 THEN 'gap_stop' WHEN j > i AND side * (o - tg) >= 0 THEN 'gap_target' WHEN j > i AND side * (best - tg * (1 + side * {past})) >= 0 AND side * (worst - st) > 0 THEN 'target' WHEN side * (worst - st) <= 0 THEN 'stop' END AS why FROM j),
e AS (SELECT run, symbol, i, ts, side, fill, hold, liq, any_value(st) AS st, any_value(tg) AS tg, coalesce(min(j) FILTER (why IS NOT NULL), max(j)) AS x, arg_min(why, j) FILTER (why IS NOT NULL) AS why FROM k GROUP BY ALL),
y AS (SELECT e.* EXCLUDE (why), n.ts AS exit_ts, coalesce(why, CASE WHEN x = e.i + hold THEN 'time' ELSE 'open' END) AS why, CASE WHEN why LIKE 'gap%' THEN n.open WHEN why = 'target' THEN tg WHEN why = 'stop' THEN st ELSE n.close END AS level FROM e JOIN n ON n.symbol = e.symbol AND n.i = x),
nx AS (SELECT a.run, a.symbol, a.i, min(b.i) AS nxt FROM y a LEFT JOIN y b ON b.run = a.run AND b.symbol = a.symbol AND b.i > a.x GROUP BY 1, 2, 3),
ch AS (SELECT run, symbol, min(i) AS i FROM y GROUP BY 1, 2 UNION ALL SELECT nx.run, nx.symbol, nxt FROM ch JOIN nx USING (run, symbol, i) WHERE nxt IS NOT NULL),
l AS (SELECT y.*, CASE WHEN why LIKE '%target' THEN level ELSE level * (1 - side * {costs.slip}::DOUBLE / 1e4) END AS leave FROM y JOIN ch USING (run, symbol, i)),
m AS (SELECT *, coalesce(why LIKE '%stop' AND side * (liq - leave) >= 0, false) AS gone FROM l),
trades AS (SELECT run, symbol, ts AS entry_ts, exit_ts, side, fill AS entry, CASE WHEN gone THEN liq ELSE leave END AS exit, CASE WHEN gone THEN 'liquidated' ELSE why END AS reason,
  {costs.maker} + CASE WHEN gone THEN 0 WHEN why LIKE '%target' THEN {costs.maker} ELSE {costs.taker} END::DOUBLE AS fees_bps,
  CASE WHEN gone THEN -{margin} ELSE side * (leave / fill - 1) * 1e4 END - ({costs.maker} + CASE WHEN gone THEN 0 WHEN why LIKE '%target' THEN {costs.maker} ELSE {costs.taker} END::DOUBLE) AS net_bps FROM m)
{tail}"""


def _query(*parts, **settings) -> str:
    return sql(_fade_sql(*parts, **settings), "bars").replace("WITH", "WITH RECURSIVE", 1)


@query("range_fade", _query("SELECT * FROM bars", [E.Fade("range", 8, 12)], E.Costs(), f"SELECT {_TRADE} FROM trades"))
def range_fade(s: SparkSession, d: str) -> DataFrame:
    return r6(sequential.range_fade(V.bars(s, d), "symbol", 8, 12))


_RISKY, _RUN = E.Costs(2.0, 6.0, 3.0, 1.0), [E.Fade("tight", 6, 10, 0.1, 0.2, 0.6, 50.0, 0.9)]


@query("range_fade_leveraged", _query("SELECT * FROM bars", _RUN, _RISKY, f"SELECT {_TRADE}, fees_bps FROM trades", leverage=2.0, step=HOUR, allow="volume > 20"))
def range_fade_leveraged(s: SparkSession, d: str) -> DataFrame:
    b = V.bars(s, d).withColumn("busy", F.col("volume") > 20)
    return r6(E.fade_trades(b, "symbol", _RUN, _RISKY, leverage=2.0, step=HOUR, allow="busy").drop("run"))


_SHUFFLED = """
, s0 AS (SELECT symbol, ts, (ts - 1) // 86400000 AS day, first_value(open) OVER o AS base, coalesce(lag(close) OVER o, open) AS p, open, high, low, close FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
s1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS a, row_number() OVER (PARTITION BY symbol, day ORDER BY md5('7:' || symbol || ':' || ts), ts) AS b FROM s0),
s2 AS (SELECT x.symbol, x.ts, x.base, ln(y.open / y.p) AS o, ln(y.high / y.p) AS h, ln(y.low / y.p) AS l, ln(y.close / y.p) AS c FROM s1 x JOIN s1 y ON y.symbol = x.symbol AND y.day = x.day AND y.b = x.a),
s3 AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - c AS before FROM s2),
shuffled AS (SELECT symbol, ts, base * exp(before + o) AS open, base * exp(before + h) AS high, base * exp(before + l) AS low, base * exp(before + c) AS close FROM s3)"""


@query("shuffled_bars", sql(f"{_SHUFFLED} SELECT symbol, ts, round(ln(open), 6) AS open, round(ln(high), 6) AS high, round(ln(low), 6) AS low, round(ln(close), 6) AS close FROM shuffled", "bars"))
def shuffled_bars(s: SparkSession, d: str) -> DataFrame:
    """Logarithms, since the path may go far."""
    return r6(E.shuffled_bars(V.bars(s, d), "symbol", 7).withColumns({c: ln(c) for c in ("open", "high", "low", "close")}))


_GRID = [E.Fade(f"l{n}h{h}e{int(100 * e)}", n, h, e, 0.2, 0.6) for n in (6, 12) for h in (6, 12) for e in (0.1, 0.25)]
_COSTS = E.Costs(2.0, 6.0, 1.0, 0.5)
_SPLIT, _RECENT = 1_704_067_200_000 + 15 * DAY, 1_704_067_200_000 + 25 * DAY
_REPORT = f"""
, g2 AS (SELECT *, unnest(list_filter([CASE WHEN exit_ts < {_SPLIT} THEN 'before' END, CASE WHEN entry_ts >= {_SPLIT} THEN 'after' END, CASE WHEN entry_ts >= {_RECENT} THEN 'recent' END], lambda x: x IS NOT NULL)) AS segment FROM trades)
SELECT split_part(symbol, '/', 1) AS bars, run, segment, count(*) AS trades, count(DISTINCT entry_ts // 86400000) AS days, round(avg(net_bps), 6) AS mean_net, round(avg(CASE WHEN net_bps > 0 THEN 1.0 ELSE 0 END), 6) AS won, round(avg(net_bps) FILTER (net_bps > 0), 6) AS mean_win,
  round(avg(net_bps) FILTER (net_bps <= 0), 6) AS mean_loss, round(avg(CASE WHEN reason IN ('stop', 'gap_stop', 'time', 'open') THEN 1.0 ELSE 0 END), 6) AS by_taker, round(avg(CASE WHEN reason = 'liquidated' THEN 1.0 ELSE 0 END), 6) AS liquidated, round(avg(fees_bps), 6) AS mean_fees FROM g2 GROUP BY 1, 2, 3"""


@query("range_fade_grid", sql(_SHUFFLED + _fade_sql("SELECT 'real/' || symbol AS symbol, ts, open, high, low, close FROM bars UNION ALL SELECT 'shuffled/' || symbol, ts, round(open, 6), round(high, 6), round(low, 6), round(close, 6) FROM shuffled", _GRID, _COSTS, _REPORT, leverage=3.0), "bars").replace("WITH", "WITH RECURSIVE", 1))
def range_fade_grid(s: SparkSession, d: str) -> DataFrame:
    cols = ["symbol", "ts", "open", "high", "low", "close"]
    named = lambda df, n: df.select(F.concat(F.lit(f"{n}/"), "symbol").alias("symbol"), *cols[1:])
    b = V.bars(s, d).select(*cols)
    both = named(b, "real").unionByName(named(r6(E.shuffled_bars(b, "symbol", 7)), "shuffled"))
    t = E.segments(E.fade_trades(both, "symbol", _GRID, _COSTS, leverage=3.0), _SPLIT, _RECENT)
    return r6(E.fade_report(t.withColumn("bars", F.substring_index("symbol", "/", 1)), ["bars", "run", "segment"]))


_DRAWS = 100
_BOOT_RUNS = [E.Fade("quick", 6, 6, 0.1, 0.2, 0.6), E.Fade("slow", 12, 12, 0.25, 0.2, 0.6)]


def _redrawn_sql(days: str, by: str, sums: str) -> str:
    """days (by, day, ...) numbered, and drawn: as many days as a group has, by the same MD5 as the operator's."""
    return f"""
i AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS m FROM {days}),
pk AS (SELECT {by}, d AS draw, ('0x' || md5('11:' || d || ':' || i)[1:8])::BIGINT % m AS i FROM i, range({_DRAWS}) r(d) WHERE m > 1),
dr AS (SELECT pk.{by}, draw, {sums} FROM pk JOIN i USING ({by}, i) GROUP BY 1, 2)"""


@query("fade_mean_intervals", _query("SELECT * FROM bars", _BOOT_RUNS, E.Costs(), f"""
, ds AS (SELECT run, entry_ts // 86400000 AS day, sum(net_bps) AS total, count(*) AS n FROM trades GROUP BY 1, 2), {_redrawn_sql("ds", "run", "sum(total) / sum(n) AS x")}
SELECT a.run, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT run, sum(total) / sum(n) AS mean FROM ds GROUP BY 1) a LEFT JOIN (SELECT run, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM dr GROUP BY 1) b USING (run)"""))  # fmt: skip
def fade_mean_intervals(s: SparkSession, d: str) -> DataFrame:
    return r6(E.mean_interval(E.fade_trades(V.bars(s, d), "symbol", _BOOT_RUNS), ["run"], _DRAWS, 11))


@query("fade_difference_intervals", sql(_SHUFFLED + _fade_sql("SELECT 'real/' || symbol AS symbol, ts, open, high, low, close FROM bars UNION ALL SELECT 'shuffled/' || symbol, ts, round(open, 6), round(high, 6), round(low, 6), round(close, 6) FROM shuffled", _BOOT_RUNS, E.Costs(), f"""
, d0 AS (SELECT run, entry_ts // 86400000 AS day, sum(CASE WHEN symbol LIKE 'real/%' THEN net_bps ELSE 0 END) AS ta, count(*) FILTER (symbol LIKE 'real/%') AS na, sum(CASE WHEN symbol LIKE 'real/%' THEN 0 ELSE net_bps END) AS tb, count(*) FILTER (symbol NOT LIKE 'real/%') AS nb FROM trades GROUP BY 1, 2),
{_redrawn_sql("d0", "run", "sum(ta) AS ta, sum(na) AS na, sum(tb) AS tb, sum(nb) AS nb")}
SELECT a.run, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT run, sum(ta) / sum(na) - sum(tb) / sum(nb) AS difference FROM d0 GROUP BY 1) a
LEFT JOIN (SELECT run, quantile_cont(ta / na - tb / nb, 0.025) AS low, quantile_cont(ta / na - tb / nb, 0.975) AS high FROM dr WHERE na > 0 AND nb > 0 GROUP BY 1) b USING (run)"""), "bars").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def fade_difference_intervals(s: SparkSession, d: str) -> DataFrame:
    b = V.bars(s, d)
    real, control = E.fade_trades(b, "symbol", _BOOT_RUNS), E.fade_trades(r6(E.shuffled_bars(b, "symbol", 7)), "symbol", _BOOT_RUNS)
    return r6(E.difference_interval(real, control, ["run"], _DRAWS, 11))

"""Queries of the factor books: one banded run, its years, a sweep of settings and shuffled controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import books as B
from tidemark.operators.research import over_periods
from tidemark.plans import studies  # noqa: F401 - registers capacity
from tidemark.plans.registry import _BOOK, _FACT, QUERIES, _scored, query, r6
from tidemark.sources.views import sql

_INPUT = f"""
, {_FACT}, x AS (SELECT t, symbol, close, funding, blend, 1 + (symbol % 4)::DOUBLE AS risk, 5 + (symbol % 3)::DOUBLE AS cost FROM s)"""

#: Runs as a table, then each run's books one after another: the recursion carries every name's sign.
_RUNS = """
, e AS (SELECT min(t) AS a, max(t) AS b FROM x),
h AS (SELECT run, hold, share, band, late, t, symbol, risk, cost, CASE WHEN late = 0 THEN blend WHEN lag(t, late) OVER o = t - late THEN lag(blend, late) OVER o END AS score,
        CASE WHEN lead(t, hold) OVER o = t + hold THEN ln(lead(close, hold) OVER o / close) * 1e4 - sum(coalesce(funding, 0)) OVER (PARTITION BY run, symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND hold FOLLOWING) END AS fwd
      FROM x, runs WINDOW o AS (PARTITION BY run, symbol ORDER BY t)),
g AS (SELECT run, hold, share, band, k, a + k * hold AS t, symbol FROM runs, e, unnest(range(0, (b - hold - a) // hold + 1)) u(k), (SELECT DISTINCT symbol FROM x)),
c AS (SELECT g.*, risk, cost, fwd, score, h.t IS NOT NULL AS listed, score IS NOT NULL AS usable FROM g LEFT JOIN h ON h.run = g.run AND h.t = g.t AND h.symbol = g.symbol),
n AS (SELECT *, count(*) FILTER (usable) OVER (PARTITION BY run, k) AS n, row_number() OVER (PARTITION BY run, k, usable ORDER BY score, symbol) - 1 AS rank, avg(fwd) OVER (PARTITION BY run, k) AS market FROM c),
z AS (SELECT *, CASE WHEN n < 6 THEN 0 WHEN 2 * greatest(1, round_even(n * share, 0)) > n THEN n // 2 ELSE greatest(1, round_even(n * share, 0)) END::BIGINT AS size FROM n),
d AS (SELECT *, CASE WHEN band > 0 THEN least(n - size, greatest(size, round_even(n * (share + band), 0))) ELSE size END::BIGINT AS wide FROM z),
bk AS (SELECT run, -1::BIGINT AS k, symbol, 0 AS sgn FROM g WHERE k = 0
  UNION ALL
  SELECT run, k, symbol, CASE WHEN up AND down THEN sgn ELSE 0 END FROM (
    SELECT *, bool_or(sgn = 1) OVER (PARTITION BY run, k) AS up, bool_or(sgn = -1) OVER (PARTITION BY run, k) AS down FROM (
      SELECT *, CASE WHEN fwd IS NULL THEN 0 WHEN long THEN 1 WHEN usable AND ps < 1e9 AND row_number() OVER (PARTITION BY run, k, usable, long ORDER BY ps, symbol) <= size THEN -1 ELSE 0 END AS sgn FROM (
        SELECT *, usable AND pl < 1e9 AND row_number() OVER (PARTITION BY run, k, usable ORDER BY pl, symbol) <= size AS long FROM (
          SELECT d.*, CASE WHEN band > 0 AND bk.sgn = 1 THEN CASE WHEN n - 1 - rank < wide THEN n - 1 - rank ELSE 1000000000 END ELSE 1000000 + n - 1 - rank END AS pl,
                 CASE WHEN band > 0 AND bk.sgn = -1 THEN CASE WHEN rank < wide THEN rank ELSE 1000000000 END ELSE 1000000 + rank END AS ps
          FROM bk JOIN d ON d.run = bk.run AND d.k = bk.k + 1 AND d.symbol = bk.symbol))))),
w AS (SELECT bk.run, bk.k, d.t, bk.symbol, d.cost, fwd - market AS excess, CASE WHEN bk.sgn = 0 THEN 0 ELSE bk.sgn / risk / sum(CASE WHEN bk.sgn <> 0 THEN 1 / risk END) OVER (PARTITION BY bk.run, bk.k, bk.sgn) END AS weight FROM bk JOIN d ON d.run = bk.run AND d.k = bk.k AND d.symbol = bk.symbol),
v AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY run, symbol ORDER BY k), 0)) AS traded, bool_or(weight <> 0) OVER (PARTITION BY run, k) AS alive FROM w),
p AS (SELECT run, t, count(*) FILTER (weight <> 0) AS names, sum(weight * coalesce(excess, 0)) / 2 AS gross, sum(traded) AS turnover, (sum(weight * coalesce(excess, 0)) - sum(traded * coalesce(cost, 10))) / 2 AS net FROM v WHERE alive GROUP BY 1, 2)"""


def _runs(*rows: tuple) -> str:
    return f", runs(run, hold, share, band, late) AS (VALUES {', '.join(map(str, rows))})"


def _sql(runs: str, tail: str) -> str:
    return sql(_INPUT + runs + _RUNS + tail, "panel").replace("WITH", "WITH RECURSIVE", 1)


_BANDED = _runs(("banded", 3, 0.3, 0.1, 1))
_GRID = [(f"h{h}s{int(100 * q)}b{int(100 * b)}", h, q, b, 0) for h in (2, 3) for q in (0.2, 0.3) for b in (0.0, 0.15)]


def _panel(s, d):
    return _scored(s, d).withColumn("risk", 1 + (F.col("symbol") % 4).cast("double")).withColumn("cost", 5 + (F.col("symbol") % 3).cast("double"))


def _books(s, d, rows, score="blend"):
    runs = [B.Run(n, h, q, b, k) for n, h, q, b, k in rows]
    return B.book_returns(B.factor_books(_panel(s, d), score, runs, risk="risk", cost="cost"))


@query("factor_book_banded", _sql(_BANDED, " SELECT run, t, names, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(net, 6) AS net FROM p"))
def factor_book_banded(s, d):
    return r6(_books(s, d, [("banded", 3, 0.3, 0.1, 1)]))


@query("factor_book_by_year", _sql(_BANDED, " SELECT (t - 1) // 12 AS year, count(*) AS periods, round(avg(net), 6) AS mean_net, round(sum(net), 6) AS total_net, round(avg(net) / stddev_samp(net) * sqrt(count(*)), 6) AS t_stat, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS gained FROM p GROUP BY 1"))
def factor_book_by_year(s, d):
    r = _books(s, d, [("banded", 3, 0.3, 0.1, 1)]).withColumn("year", F.expr("(t - 1) div 12"))
    return r6(B.run_statistics(r, ["year"]))


@query("factor_sweep", _sql(_runs(*_GRID), " SELECT run, count(*) AS periods, round(avg(net), 6) AS mean_net, round(sum(net), 6) AS total_net, round(avg(net) / stddev_samp(net) * sqrt(count(*)), 6) AS t_stat, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS gained FROM p GROUP BY 1"))
def factor_sweep(s, d):
    return r6(B.run_statistics(_books(s, d, _GRID), ["run"]))


@query("universe_split", _sql(_runs(("even", 3, 0.3, 0.0, 0)), " SELECT count(*) AS periods, round(avg(net), 6) AS mean_net FROM p").replace("5 + (symbol % 3)::DOUBLE AS cost FROM s)", "5 + (symbol % 3)::DOUBLE AS cost FROM s WHERE symbol % 2 = 0)"))
def universe_split(s, d):
    p = _panel(s, d).where("symbol % 2 = 0")
    r = B.book_returns(B.factor_books(p, "blend", [B.Run("even")], risk="risk", cost="cost"))
    return r6(r.agg(F.count(F.lit(1)).alias("periods"), F.avg("net").alias("mean_net")))


#: Every control deals each time's scores to its names anew: all are one table, told apart by the run's name.
_CONTROLS = 20
_CONTROL_SQL = f"""
, {_FACT}, y AS (SELECT t, symbol, close, funding, blend FROM s), q AS (SELECT 0 AS c UNION ALL SELECT unnest(range(1, {_CONTROLS + 1}))),
a AS (SELECT c, t, symbol, blend, row_number() OVER (PARTITION BY c, t ORDER BY symbol) AS i, row_number() OVER (PARTITION BY c, t ORDER BY CASE WHEN c = 0 THEN '' ELSE md5(c || ':' || t || ':' || symbol) END, symbol) AS j FROM y, q WHERE blend IS NOT NULL),
r1 AS (SELECT a.c, a.t, a.symbol, b.blend FROM a JOIN a b ON b.c = a.c AND b.t = a.t AND b.j = a.i),
o AS (SELECT y.*, CASE WHEN lead(t, 3) OVER o = t + 3 THEN ln(lead(close, 3) OVER o / close) * 1e4 - sum(coalesce(funding, 0)) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) END AS fwd FROM y WINDOW o AS (PARTITION BY symbol ORDER BY t)),
k AS (SELECT c, r1.t, r1.symbol, fwd, row_number() OVER (PARTITION BY c, r1.t ORDER BY r1.blend, r1.symbol) AS r, count(*) OVER (PARTITION BY c, r1.t) AS n FROM r1 JOIN o ON o.t = r1.t AND o.symbol = r1.symbol WHERE (r1.t - (SELECT min(t) FROM y)) % 3 = 0 AND r1.t + 3 <= (SELECT max(t) FROM y)),
z AS (SELECT *, CASE WHEN 2 * greatest(1, round_even(n * 0.3, 0)) > n THEN n // 2 ELSE greatest(1, round_even(n * 0.3, 0)) END AS size FROM k WHERE n >= 6),
g AS (SELECT c, t, avg(fwd) FILTER (r > n - size) - avg(fwd) FILTER (r <= size) AS gross FROM z GROUP BY 1, 2),
m AS (SELECT c, avg(gross / 2) AS gross FROM g WHERE gross IS NOT NULL GROUP BY 1)
SELECT round(any_value(real), 6) AS real, count(*) AS controls, round(avg(CASE WHEN gross < real THEN 1.0 ELSE 0 END), 6) AS percentile FROM m, (SELECT gross AS real FROM m WHERE c = 0) WHERE c > 0"""


@query("shuffled_control", sql(_CONTROL_SQL, "panel"))
def shuffled_control(s, d):
    p = _scored(s, d).select("t", "symbol", "close", "funding", "blend")
    # Only scores of rebalances are looked at. A time's names are dealt together, all controls at once.
    first = p.agg(F.min("t").alias("_first"))
    has = p.where("blend is not null").join(F.broadcast(first)).where("(t - _first) % 3 = 0").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("symbol", "blend"))).alias("x"))
    own = lambda c: lambda x: F.struct((F.md5(F.concat_ws(":", F.lit(c), "t", x["symbol"])) if c else F.lit("")).alias("key"), x["symbol"].alias("symbol"), x["blend"].alias("blend"))
    scores = [F.transform(F.array_sort(F.transform("x", own(c))), lambda x: x["blend"]).alias(str(c)) for c in range(_CONTROLS + 1)]
    dealt = has.select("t", F.transform("x", lambda x: x["symbol"]).alias("symbol"), *scores)
    dealt = dealt.select("t", F.inline(F.arrays_zip("symbol", *[f"`{c}`" for c in range(_CONTROLS + 1)])))
    wide = p.join(dealt, ["t", "symbol"], "left")
    runs = [B.Run(str(k), score=str(k)) for k in range(_CONTROLS + 1)]
    means = B.book_returns(B.factor_books(wide, "blend", runs)).groupBy("run").agg(F.avg("gross").alias("gross"))
    return r6(B.control_percentile(means.where("run = '0'"), means.where("run <> '0'"), "gross"))


@query("capacity_over_periods", sql(f"""
, {_FACT}, {_BOOK.format(more='')}, c AS (SELECT t, round(min(0.01 * volume / (abs(weight) / 2)), 2) AS ceiling FROM b JOIN panel USING (t, symbol) WHERE volume > 0 GROUP BY 1)
SELECT count(ceiling) AS periods, min(ceiling) AS least, round(quantile_cont(ceiling, 0.1), 4) AS p10, round(median(ceiling), 4) AS median, arg_max(ceiling, t) AS last FROM c""", "panel"))  # fmt: skip
def capacity_over_periods(s, d):
    c = QUERIES["capacity"](s, d)
    return over_periods(c, "t", "ceiling").select("periods", "least", F.round("p10", 4).alias("p10"), F.round("median", 4).alias("median"), "last")

"""Factor books over rebalances: entry lag, rebalance band, inverse risk, shared cluster weights, costs by name."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Names that a book needs; places of names that aren't held, and of held ones that leave.
LEAST, NEW, OUT = 6, 1 << 40, 1 << 50


@dataclass(frozen=True)
class Run:
    """One setting: times a book is held, share of names on a side, band added to it for names held, lag of the score; a score of its own."""

    name: str
    hold: int = 3
    share: float = 0.3
    band: float = 0.0
    lag: int = 0
    score: str = ""


def side_members(rank: np.ndarray, held: np.ndarray, size: int, band: int) -> np.ndarray:
    """Places of a side's `size` members: names held and ranked inside the band come first, then names not held, by rank."""
    place = np.where(held, np.where(rank < band, rank, OUT), NEW + rank)
    best = np.argsort(place, kind="stable")[:size]
    return best[place[best] < OUT]


def book_weights(score: np.ndarray, risk: np.ndarray, cluster: np.ndarray, before: np.ndarray, share: float, band: float) -> np.ndarray:
    """Weights of names in the order of their symbols; each side sums to one, longs positive. No book under LEAST names.

    A name weighs 1 / risk, divided by how many of its cluster are on its side.
    """
    out, usable = np.zeros(len(score)), np.flatnonzero(np.isfinite(score) & np.isfinite(risk) & (risk > 0))
    n = len(usable)
    if n < LEAST:
        return out
    rank = np.empty(n, np.int64)
    rank[np.argsort(score[usable], kind="stable")] = np.arange(n)
    size = max(1, round(n * share))
    size = n // 2 if 2 * size > n else size
    wide = min(n - size, max(size, round(n * (share + band)))) if band > 0 else size
    held = before[usable]
    none = np.zeros(n, bool)
    longs = side_members(n - 1 - rank, held > 0 if band > 0 else none, size, wide)
    free = np.setdiff1d(np.arange(n), longs)
    shorts = free[side_members(rank[free], held[free] < 0 if band > 0 else none[free], size, wide)]
    for side, sign in ((usable[longs], 1.0), (usable[shorts], -1.0)):
        _, at, size_of = np.unique(cluster[side], return_inverse=True, return_counts=True)
        raw = 1.0 / risk[side] / size_of[at]
        out[side] = sign * raw / raw.sum()
    return out


def factor_books(panel: DataFrame, score: str, runs: list[Run], at: str = "t", symbol: str = "symbol", risk: str | None = None, cluster: str | None = None, cost: str | None = None, cost_bps: float = 10.0, eligible: str | None = None) -> DataFrame:
    """(run, at, symbol, weight, traded, excess, charged) of each rebalance of each run, names that are held or traded.

    A run's rebalances start at the panel's first time. A book's names without a forward return leave it and each side
    is scaled up again; a time without a book empties it. excess is the forward return (price less funding paid) less the
    eligible names' mean. Forward returns of all runs come from one sorted pass; a run's books follow one another, since
    a band looks at the book before, so that each run is one task over one row a name and rebalance.
    """
    o = Window.partitionBy(symbol).orderBy(at)
    kind = dict(panel.dtypes)[symbol]
    ok = F.col(eligible) if eligible else F.lit(True)
    holds, lags = sorted({r.hold for r in runs}), sorted({(r.score or score, r.lag) for r in runs})
    forward = {h: F.when(F.lead(at, h).over(o) == F.col(at) + h, F.log(F.lead("close", h).over(o) / F.col("close")) * 1e4 - F.sum(F.coalesce(F.col("funding"), F.lit(0.0))).over(o.rowsBetween(1, h))) for h in holds}
    late = {x: F.when(F.lag(at, x[1]).over(o) == F.col(at) - x[1], F.lag(x[0], x[1]).over(o)) if x[1] else F.col(x[0]) for x in lags}
    start = panel.agg(F.min(at).alias("_start"), F.max(at).alias("_end"))
    rows = panel.select(F.col(at).cast("long").alias("t"), F.col(symbol).alias("symbol"), (F.col(risk).cast("double") if risk else F.lit(1.0)).alias("risk"), F.col(cluster).cast("string").alias("cluster") if cluster else F.lit(0).alias("cluster"), (F.col(cost).cast("double") if cost else F.lit(float(cost_bps))).alias("cost"), F.coalesce(ok, F.lit(False)).alias("ok"), *[v.alias(f"_f{h}") for h, v in forward.items()], *[v.alias(f"_s{k}") for k, v in enumerate(late.values())])
    each = F.array(*[F.struct(F.lit(k).alias("run"), F.lit(r.hold).alias("hold"), F.col(f"_f{r.hold}").alias("forward"), F.when(F.col("ok"), F.col(f"_s{lags.index((r.score or score, r.lag))}").cast("double")).alias("score")) for k, r in enumerate(runs)])
    rows = rows.withColumn("_r", F.explode(each)).join(F.broadcast(start)).where("(t - _start) % _r.hold = 0 AND t + _r.hold <= _end").select("t", "symbol", "risk", "cluster", "cost", "ok", "_r.run", "_r.forward", "_r.score").drop(*[] if cluster else ["cluster"])
    schema = pa.schema([("run", pa.string()), ("t", pa.int64()), ("symbol", to_arrow_type(panel.schema[symbol].dataType)), *[(c, pa.float64()) for c in ("weight", "traded", "excess", "charged")]])

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        own = runs[table.column("run")[0].as_py()]
        # Names are numbered in their order: books are arrays over all of them.
        names, code = np.unique(column("symbol"), return_inverse=True)
        group = pd.factorize(column("cluster"), use_na_sentinel=False)[0] if cluster else code
        times = column("t")
        order = np.lexsort((code, times))
        starts = np.flatnonzero(np.r_[True, np.diff(times[order]) != 0])
        score, risk, forward, ok, cost = (column(c) for c in ("score", "risk", "forward", "ok", "cost"))
        before, out = np.zeros(len(names)), []
        for rows in np.split(order, starts[1:]):
            at, ahead = code[rows], forward[rows]
            w = book_weights(score[rows], risk[rows], group[rows], before[at], own.share, own.band)
            w[~np.isfinite(ahead)] = 0.0
            up, down = w[w > 0].sum(), -w[w < 0].sum()
            now, excess, fee = np.zeros(len(names)), np.zeros(len(names)), np.full(len(names), float(cost_bps))
            if not up or not down:
                before = now
                continue
            w = np.where(w > 0, w / up, w / down)
            now[at], fee[at] = w, cost[rows]
            excess[at] = np.where(w != 0, ahead - np.nanmean(ahead[ok[rows]]), 0.0)
            some = np.flatnonzero((now != 0) | (before != 0))
            traded = np.abs(now[some] - before[some])
            out.append(pa.table([[own.name] * len(some), np.full(len(some), times[rows[0]]), names[some], now[some], traded, excess[some], traded * fee[some]], schema=schema))
            before = now
        return pa.concat_tables(out) if out else schema.empty_table()

    return rows.groupBy("run").applyInArrow(run, f"run string, t long, symbol {kind}, weight double, traded double, excess double, charged double")


def book_returns(books: DataFrame) -> DataFrame:
    """Per run and rebalance, per unit of gross: gross, turnover, net, and the number of names."""
    g = books.groupBy("run", "t").agg(F.sum(F.when(F.col("weight") != 0, 1).otherwise(0)).alias("names"), F.sum(F.col("weight") * F.col("excess")).alias("g"), F.sum("traded").alias("turnover"), F.sum("charged").alias("c"))
    return g.select("run", "t", "names", (F.col("g") / 2).alias("gross"), "turnover", ((F.col("g") - F.col("c")) / 2).alias("net"))


def run_statistics(returns: DataFrame, by: list[str]) -> DataFrame:
    """Periods, mean and total net, its t statistic and the share of periods that gained."""
    n = F.count(F.lit(1))
    return returns.groupBy(*by).agg(n.alias("periods"), F.avg("net").alias("mean_net"), F.sum("net").alias("total_net"), (F.avg("net") / F.when(F.stddev_samp("net") > 0, F.stddev_samp("net")) * F.sqrt(n)).alias("t_stat"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("gained"))


def control_percentile(real: DataFrame, controls: DataFrame, value: str) -> DataFrame:
    """The share of control runs whose value is below the real run's, and how many there are."""
    r = real.agg(F.first(value).alias("real"))
    return controls.join(F.broadcast(r)).agg(F.first("real").alias("real"), F.count(F.lit(1)).alias("controls"), F.avg(F.when(F.col(value) < F.col("real"), 1.0).otherwise(0.0)).alias("percentile"))

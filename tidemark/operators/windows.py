"""Trailing, forward and gap-aware windows over a key's rows in time order."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.ieee import ln, ratio

FIRST = -sys.maxsize


def ordered(key: str, at: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(at)


def full(agg: Column, over: WindowSpec, rows: int, start: int, end: int) -> Column:
    """agg over rows start..end, null until there are `rows` of them."""
    w = over.rowsBetween(start, end)
    return F.when(F.count(F.lit(1)).over(w) == rows, agg.over(w))


def trailing_extremes(over: WindowSpec, high: str, low: str, w: int) -> tuple[Column, Column]:
    """Highest and lowest of the w rows before the current one, which is excluded."""
    return full(F.max(high), over, w, -w, -1), full(F.min(low), over, w, -w, -1)


def forward_extremes(over: WindowSpec, high: str, low: str, w: int) -> tuple[Column, Column]:
    return full(F.max(high), over, w, 1, w), full(F.min(low), over, w, 1, w)


def trailing_mean_before(over: WindowSpec, col: str, w: int) -> Column:
    return full(F.avg(col), over, w, -w, -1)


def trailing_sum(over: WindowSpec, col: str, w: int) -> Column:
    """Sum including the current row, missing values as zero, null until w rows."""
    return full(F.sum(F.coalesce(F.col(col), F.lit(0.0))), over, w, 1 - w, 0)


def trailing_sum_tolerant(over: WindowSpec, col: str, w: int) -> Column:
    """Sum including the current row where at most one of w values is missing."""
    r = over.rowsBetween(1 - w, 0)
    return F.when((F.count(F.lit(1)).over(r) == w) & (F.count(col).over(r) >= w - 1), F.sum(col).over(r))


def trailing_mean(over: WindowSpec, col: str, w: int) -> Column:
    """Mean of the values there are, the current row included, from row w on."""
    return full(F.avg(col), over, w, 1 - w, 0)


def trailing_mean_covered(over: WindowSpec, col: str, w: int, share: float = 0.8) -> Column:
    """Mean where at least `share` of w values are there; valid one row later than the window is full."""
    r = over.rowsBetween(1 - w, 0)
    return F.when((F.row_number().over(over) > w) & (F.count(col).over(r) >= share * w), F.avg(col).over(r))


def trailing_std(over: WindowSpec, col: str, w: int) -> Column:
    """Population deviation of w values, valid one row later than the window is full."""
    r = over.rowsBetween(1 - w, 0)
    return F.when((F.row_number().over(over) > w) & (F.count(col).over(r) == w), F.stddev_pop(col).over(r))


def trailing_skew(over: WindowSpec, col: str, w: int) -> Column:
    r = over.rowsBetween(1 - w, 0)
    return F.when(F.count(col).over(r) == w, F.skewness(col).over(r))


def contiguous_back(over: WindowSpec, at: str, step: int, rows: int) -> Column:
    """Do the `rows` rows before the current one stand exactly `step` apart up to it?"""
    return F.coalesce(F.col(at) - F.lag(at, rows).over(over) == F.lit(step * rows), F.lit(False))


def contiguous_forward(over: WindowSpec, at: str, step: int, rows: int) -> Column:
    return F.coalesce(F.lead(at, rows).over(over) - F.col(at) == F.lit(step * rows), F.lit(False))


def break_count(df: DataFrame, key: str, at: str, step: int) -> DataFrame:
    """df with `breaks`, how many holes a key has had up to each row: two rows with one count have none between them."""
    o = ordered(key, at)
    gap = F.when(F.col(at) - F.lag(at).over(o) != step, 1).otherwise(0)
    return df.withColumn("_gap", gap).withColumn("breaks", F.sum("_gap").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def log_return(over: WindowSpec, col: str, back: int, scale: float = 1e4) -> Column:
    """Log return over `back` rows in bps; 0 where either price isn't positive, null without the earlier row."""
    was = F.lag(col, back).over(over)
    return F.when(was.isNull() | F.col(col).isNull(), None).when((was <= 0) | (F.col(col) <= 0), 0.0).otherwise(F.log(F.col(col) / was) * scale)


def forward_log_return(over: WindowSpec, col: str, ahead: int, scale: float = 1e4) -> Column:
    return F.log(F.lead(col, ahead).over(over) / F.col(col)) * scale


def range_position(over: WindowSpec, close: str, high: str, low: str, w: int) -> Column:
    hi, lo = full(F.max(high), over, w, 1 - w, 0), full(F.min(low), over, w, 1 - w, 0)
    return F.when(hi > lo, (F.col(close) - lo) / (hi - lo)).when(hi.isNotNull(), 0.5)


def ma_distance(over: WindowSpec, close: str, w: int, scale: float = 1e4) -> Column:
    """Log distance from the mean of the w + 1 closes up to now."""
    return ln(ratio(close, full(F.avg(close), over, w + 1, -w, 0))) * scale


def time_sum(key: str, ms: int, col: Column, at: str = "ts") -> Column:
    """Sum over the last ms milliseconds, both ends inclusive."""
    return F.sum(col).over(Window.partitionBy(key).orderBy(at).rangeBetween(-ms, 0))


def rolled(df: DataFrame, key: str, sums: dict[str, tuple[str, int]], counts: dict[str, int] | None = None, firsts: dict[str, tuple[str, int]] | None = None, at: str = "ts") -> DataFrame:
    """df with sums of a column over the last ms (column, ms), row counts (ms) and the first row's value of a column (column, ms), all ends inclusive.

    Spark goes over every row of a range frame again for each row; here prefix sums, in extended precision, make each window two
    look-ups. A key's time is dealt to buckets of four times the longest window, and a bucket brings along what its windows
    reach back to. Missing values count as zero.
    """
    counts, firsts = counts or {}, firsts or {}
    longest = max([ms for _, ms in [*sums.values(), *firsts.values()]] + [*counts.values()])
    bucket = 4 * longest + 1
    own = F.floor(F.col(at) / bucket)
    # The bucket's number leads each row's copies: the first is its own.
    d = df.withColumn("_cell", F.explode(F.sequence(own, F.floor((F.col(at) + longest) / bucket)))).withColumn("_own", F.col("_cell") == own)
    types = {**{n: "double" for n in sums}, **{n: "long" for n in counts}, **{n: dict(df.dtypes)[c] for n, (c, _) in firsts.items()}}
    schema = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in types.items())).fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(at).combine_chunks()
        t = table.column(at).to_numpy()
        end = np.searchsorted(t, t, "right")
        start = {ms: np.searchsorted(t, t - ms, "left") for ms in {ms for _, ms in [*sums.values(), *firsts.values()]} | set(counts.values())}
        out = {}
        for n, (c, ms) in sums.items():
            x = table.column(c).fill_null(0).to_numpy().astype(float)
            odd = ~np.isfinite(x)
            total = np.r_[0, np.cumsum(np.where(odd, 0, x).astype(np.longdouble))]
            s = (total[end] - total[start[ms]]).astype(float)
            bad = np.r_[0, np.cumsum(odd)]
            for i in np.flatnonzero(bad[end] > bad[start[ms]]):
                s[i] = x[start[ms][i] : end[i]].sum()
            out[n] = pa.array(s)
        out |= {n: pa.array(end - start[ms]) for n, ms in counts.items()} | {n: table.column(c).take(pa.array(start[ms])) for n, (c, ms) in firsts.items()}
        for n, v in out.items():
            table = table.append_column(n, v)
        return table.filter(table.column("_own")).select([f.name for f in schema.fields])

    return d.groupBy(key, "_cell").applyInArrow(run, schema)


def forward_fill(over: WindowSpec, col: str) -> Column:
    return F.last(col, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def unbroken_run(df: DataFrame, key: str, at: str, ok: str) -> DataFrame:
    """df with `run`: rows in a row up to this one for which `ok` holds."""
    o = ordered(key, at)
    df = df.withColumn("_off", F.sum(F.when(F.col(ok), 0).otherwise(1)).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_off").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("run", F.sum(F.when(F.col(ok), 1).otherwise(0)).over(inside)).drop("_off")


def swing_points(over: WindowSpec, high: str, low: str, look: int) -> tuple[Column, Column]:
    """Is no neighbour within `look` rows on either side higher (lower)? Ties are swings; the ends, without all neighbours, aren't."""
    r = over.rowsBetween(-look, look)
    whole = F.count(F.lit(1)).over(r) == 2 * look + 1
    return whole & (F.max(high).over(r) <= F.col(high)), whole & (F.min(low).over(r) >= F.col(low))


def drawdown(df: DataFrame, key: str, at: str, ret: str) -> DataFrame:
    """df with `equity` (compounded, each return at least -1) and `dd`, its fall from the highest value so far, from 1."""
    o = ordered(key, at).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.greatest(1 + F.col(ret), F.lit(0.0))
    df = df.withColumn("equity", F.when(F.max(F.when(grown <= 0, 1).otherwise(0)).over(o) == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(grown > 0, grown))).over(o))))
    return df.withColumn("dd", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(o)) - 1)


def ofi(df: DataFrame, key: str) -> DataFrame:
    """Touches with `ofi`, the order-flow imbalance increment from the touch before; 0 for the first."""
    o = Window.partitionBy(key).orderBy("ts", "seq")
    pb, pbs, pa, pas = (F.lag(c).over(o) for c in ("bid", "bid_sz", "ask", "ask_sz"))
    bid = F.when(F.col("bid") > pb, F.col("bid_sz")).when(F.col("bid") == pb, F.col("bid_sz") - pbs).otherwise(-pbs)
    ask = F.when(F.col("ask") < pa, -F.col("ask_sz")).when(F.col("ask") == pa, pas - F.col("ask_sz")).otherwise(pas)
    return df.withColumn("ofi", F.coalesce(bid + ask, F.lit(0.0)))


def realised_vol(df: DataFrame, key: str, ms: int, mid: str = "mid") -> DataFrame:
    """df with `rv`: root of the squared steps after the first sample within ms, per second between first and last, as a plain ratio; 0 under 3 samples."""
    o = Window.partitionBy(key).orderBy("ts")
    r = o.rangeBetween(-ms, 0)
    df = df.withColumn("_r2", F.coalesce(F.pow(ln(ratio(mid, F.lag(mid).over(o))), 2), F.lit(0.0)))
    span = (F.col("ts") - F.min("ts").over(r)) / 1000
    later = F.sum("_r2").over(r) - F.first("_r2").over(r)
    return df.withColumn("rv", F.when((F.count(F.lit(1)).over(r) < 3) | (span <= 0), 0.0).otherwise(F.sqrt(F.greatest(later, F.lit(0.0)) / span))).drop("_r2")

"""Time joins. None of them compares every row with every other: each sorts the two sides of a key together once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, key: str, values: list[str], tie: str, lag_ms: int = 0) -> DataFrame:
    """Rows of both sides in one frame: is_left, ts to look up at, payload r (null on the left)."""
    r = right.select(F.col(key), F.col("ts").alias("_t"), F.lit(0).alias("_left"), F.struct(F.col("ts"), *values).alias("_r"), F.col(tie).alias("_tie"), F.lit(None).cast(left_struct(left)).alias("_l"))
    packed = F.struct(*left.columns)
    l = left.select(F.col(key), (F.col("ts") - lag_ms).alias("_t"), F.lit(1).alias("_left"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), packed.alias("_l"))  # noqa: E741
    return r.unionByName(l)


def left_struct(df: DataFrame) -> str:
    return df.schema.simpleString()


#: Bands that are broadcast, at most.
MOST_BANDS = 10_000
#: As-of joins sort this much time of a key in one task; what lies before comes from one row a bucket.
BUCKET_MS = 86_400_000


def _carried(b: DataFrame, key: str, ahead: bool, bucket_ms: int) -> DataFrame:
    """b with `_m`, the nearest right row at or before (after, if ahead) each row, ties settled by `_tie`.

    A hot key is spread over its buckets: each is sorted by itself, and a bucket's open side takes the nearest right row
    of the buckets beyond it, found over one row a bucket. The join back keeps the partitioning of the sort.
    """
    b = b.withColumn("_cell", F.floor(F.col("_t") / bucket_ms))
    order = [F.desc("_t"), F.col("_left"), F.desc_nulls_last("_tie")] if ahead else [F.col("_t"), F.col("_left"), F.asc_nulls_first("_tie")]
    inside = b.withColumn("_in", F.last("_r", ignorenulls=True).over(Window.partitionBy(key, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("_left") == 0, F.struct("_t", "_tie"))
    ends = b.groupBy(F.col(key).alias("_key"), F.col("_cell").alias("_c")).agg((F.min_by if ahead else F.max_by)("_r", place).alias("_end"))
    past = Window.partitionBy("_key").orderBy(F.desc("_c") if ahead else F.col("_c")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_key", "_c", F.last("_end", ignorenulls=True).over(past).alias("_far")).where("_far is not null")
    return inside.join(ends, inside[key].eqNullSafe(F.col("_key")) & inside["_cell"].eqNullSafe(F.col("_c")), "left").withColumn("_m", F.coalesce("_in", "_far"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, values: list[str], tie: str = "seq", lag_ms: int = 0, keep_unmatched: bool = True, clamp_first: bool = False, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """left with the values of the last right row at or before its ts (less lag_ms), as r_ts and r_<value>.

    Of right rows with one ts the last by `tie` counts. clamp_first gives rows before the first right row that first one.
    """
    b = _carried(_both(left, right, key, values, tie, lag_ms), key, False, bucket_ms)
    if clamp_first:
        first = right.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct("ts", *values), F.struct("ts", tie)).alias("_first"))
        b = b.join(first, b[key].eqNullSafe(F.col("_k")), "left").withColumn("_m", F.coalesce("_m", "_first"))
    return _unpacked(b, left, values, keep_unmatched)


def asof_forward(left: DataFrame, right: DataFrame, key: str, values: list[str], tie: str = "seq", ahead_ms: int = 0, tolerance_ms: int | None = None, keep_unmatched: bool = True, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """left with the values of the first right row at or after its ts plus ahead_ms; with a tolerance, no later than that."""
    b = _carried(_both(left, right, key, values, tie, -ahead_ms), key, True, bucket_ms)
    if tolerance_ms is not None:
        b = b.withColumn("_m", F.when(F.col("_m.ts") <= F.col("_t") + tolerance_ms, F.col("_m")))
    return _unpacked(b, left, values, keep_unmatched)


def _unpacked(b: DataFrame, left: DataFrame, values: list[str], keep: bool) -> DataFrame:
    out = b.where("_left = 1") if keep else b.where("_left = 1 and _m is not null")
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], F.col("_m.ts").alias("r_ts"), *[F.col(f"_m.{v}").alias(f"r_{v}") for v in values])


def interval_join(points: DataFrame, intervals: DataFrame, key: str, ahead_ms: int, bucket_ms: int, strict_start: bool = True) -> DataFrame:
    """Points with ts in (start, start + ahead_ms] of an interval, by buckets: each interval goes to the few buckets it meets."""
    lo = F.col("i_ts") if not strict_start else F.col("i_ts") + 1
    cells = F.sequence(F.floor(lo / bucket_ms), F.floor((F.col("i_ts") + ahead_ms) / bucket_ms))
    i = intervals.select(*[F.col(c).alias(f"i_{c}") for c in intervals.columns]).withColumn("_cell", F.explode(cells))
    p = points.withColumn("_cell", F.floor(F.col("ts") / bucket_ms))
    on = (p[key] == i[f"i_{key}"]) & (p["_cell"] == i["_cell"]) & (p["ts"] >= lo) & (p["ts"] <= F.col("i_ts") + ahead_ms)
    return p.join(i, on).drop("_cell")


def band_join(df: DataFrame, bands: DataFrame, value: str, low: str, high: str, out: list[str]) -> DataFrame:
    """Columns `out` of the band that holds a value (low exclusive, high inclusive); below the first band the first, above the last the last.

    Up to MOST_BANDS bands become one sorted array in a single row that rows look up in place; more are joined as of
    their upper ends.
    """
    if bands.limit(MOST_BANDS + 1).count() > MOST_BANDS:
        last = bands.agg(F.max_by(F.struct(*out), high).alias("_last"))
        marks = bands.select(F.lit(0).alias("_k"), F.col(high).alias("ts"), F.col(low).alias("_low"), *out)
        left = df.select(F.struct(*df.columns).alias("_row"), F.lit(0).alias("_k"), F.col(value).cast("double").alias("ts"))
        found = asof_forward(left, marks, "_k", out, tie="_low", bucket_ms=1)
        return found.join(F.broadcast(last)).select("_row.*", *[F.when(F.col("r_ts").isNull(), F.col(f"_last.{c}")).otherwise(F.col(f"r_{c}")).alias(c) for c in out])
    table = bands.agg(F.array_sort(F.collect_list(F.struct(low, high, *out))).alias("_bands"))
    inside = F.filter("_bands", lambda b: F.col(value) <= b[high])
    found = F.coalesce(F.get(inside, F.lit(0)), F.element_at("_bands", -1))
    return df.join(F.broadcast(table)).withColumn("_b", found).select(*df.columns, *[F.col(f"_b.{c}").alias(c) for c in out])


def scaffold(df: DataFrame, key: str, at: str, step: int) -> DataFrame:
    """Every key at every step between the first and last `at` of all: missing cells are rows of nulls."""
    ends = df.agg(F.min(at).alias("a"), F.max(at).alias("b"))
    grid = df.select(key).distinct().join(F.broadcast(ends)).select(key, F.explode(F.sequence("a", "b", F.lit(step))).alias(at))
    return grid.join(df, [key, at], "left")


def bucket_join(frames: dict[str, DataFrame], key: str, bucket_ms: int, value: str) -> DataFrame:
    """Series that meet in one time bucket: the last value of each by name, buckets that all of them have."""
    last = [d.groupBy(key, F.floor(F.col("ts") / bucket_ms).alias("bucket")).agg(F.max_by(value, F.struct("ts", "seq")).alias(n)) for n, d in frames.items()]
    return reduce(lambda a, b: a.join(b, [key, "bucket"]), last)


def outer_deltas(current: DataFrame, target: DataFrame, key: str, value: str, epsilon: float = 1e-12) -> DataFrame:
    """Current against target by key, both sides kept: what to add or take away, where it isn't nothing."""
    j = current.select(key, F.col(value).alias("current")).join(target.select(key, F.col(value).alias("target")), key, "full")
    j = j.fillna(0.0, ["current", "target"]).withColumn("delta", F.col("target") - F.col("current"))
    state = F.when(F.col("current") == 0, "open").when(F.col("target") == 0, "close").otherwise("resize")
    return j.where(F.abs("delta") > epsilon).withColumn("action", state)


def offset_join(df: DataFrame, key: str, at: str, offset: int, values: list[str], prefix: str = "o_") -> DataFrame:
    """df with the values of its own key's row `offset` steps later (earlier, if negative); rows without one have nulls."""
    o = df.select(F.col(key), (F.col(at) - offset).alias(at), *[F.col(v).alias(prefix + v) for v in values])
    return df.join(o, [key, at], "left")


#: Keys of a block, times of a span, and pairs that leave Python at once.
BLOCK, SPAN, PAIRS = 2048, 512, 250_000


def _pair_blocks(df: DataFrame, key: str, at: str, value: str, block: int, span: int, emit, schema: str) -> DataFrame:
    """What `emit` makes of the pairs of every two blocks of keys: it gets frames of (a, b, n, corr) that end with None at the end of a part.

    A key's values become one row a span of times; such rows go to every pair of blocks with their own, which adds up the spans one
    after another. Pairs' sums never leave their part, so that what is shuffled grows with keys times blocks, not with pairs.
    """
    x = df.select(F.col(key).alias("k"), F.col(at).cast("long").alias("t"), F.col(value).cast("double").alias("v")).where("v is not null")
    packed = x.groupBy("k", F.expr(f"floor(t / {span})").alias("cell")).agg(F.collect_list(F.struct(F.pmod("t", F.lit(span)).cast("short").alias("t"), "v")).alias("x"))
    blocks = max(1, -(-x.select("k").distinct().count() // block))
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.greatest(own, o) * blocks + F.least(own, o)))
    p = packed.select("k", "cell", F.col("x.t").alias("ts"), F.col("x.v").alias("vs"), own.alias("own"), part.alias("part"))
    p = p.repartition(blocks * (blocks + 1) // 2, "part").sortWithinPartitions("part", "cell")

    def matrices(rows: list, index: dict) -> tuple[np.ndarray, np.ndarray]:
        at_k = np.array([index.setdefault(r[0], len(index)) for r in rows], np.int64)
        v, has = np.zeros((len(index), span)), np.zeros((len(index), span))
        if rows:
            at_k, at_t = np.repeat(at_k, [len(r[1]) for r in rows]), np.concatenate([r[1] for r in rows])
            v[at_k, at_t], has[at_k, at_t] = np.concatenate([r[2] for r in rows]), 1.0
        return v, has

    def sums(a, b, lines: slice) -> list[np.ndarray]:
        (v, h), (w, g) = (a[0][lines], a[1][lines]), b
        return [h @ g.T, v @ g.T, h @ w.T, (v * v) @ g.T, h @ (w * w).T, v @ w.T]

    def pairs(a: dict, b: dict, get, within: bool) -> Iterator[pd.DataFrame]:
        """a's keys against b's; within one block each pair once."""
        ka, kb = np.array(list(a)), np.array(list(b))
        step = max(1, PAIRS // max(1, len(kb)))
        for i in range(0, len(ka), step):
            n, sx, sy, sxx, syy, sxy = get(slice(i, min(i + step, len(ka))))
            less = ka[i : i + step, None] < kb[None, :]
            r, c = np.nonzero((n > 0) & less if within else n > 0)
            n, sx, sy, sxx, syy, sxy = (s[r, c] for s in (n, sx, sy, sxx, syy, sxy))
            vx, vy = n * sxx - sx * sx, n * syy - sy * sy
            still = (vx <= 1e-12 * n * sxx) | (vy <= 1e-12 * n * syy)
            corr = np.full(len(n), np.nan)
            np.divide(n * sxy - sx * sy, np.sqrt(np.where(still, 1.0, vx * vy)), out=corr, where=~still)
            x, y, first = ka[i + r], kb[c], less[r, c]
            yield pd.DataFrame({"a": np.where(first, x, y), "b": np.where(first, y, x), "n": n.astype(np.int64), "corr": corr})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for pdf in batches:
                yield from zip(pdf["part"], pdf["cell"], pdf["own"], pdf["k"], pdf["ts"], pdf["vs"], strict=True)

        def frames():
            for number, rest in groupby(rows(), lambda r: r[0]):
                high, low = divmod(number, blocks)
                a: dict = {}
                b: dict = a if high == low else {}
                whole, seen = None, None
                for _, cell in groupby(rest, lambda r: r[1]):
                    if seen is not None:  # a second span: sums of all pairs are kept from now on
                        whole = added(whole, sums(*seen, slice(None)))
                    sides: dict = {high: [], low: []}
                    for _, _, home, *row in cell:
                        sides[home].append(row)
                    m = matrices(sides[high], a)
                    o = m if high == low else matrices(sides[low], b)
                    met = m[1].any(axis=0) & o[1].any(axis=0)
                    seen = (m[0][:, met], m[1][:, met]), (o[0][:, met], o[1][:, met])
                if whole is not None:
                    whole = added(whole, sums(*seen, slice(None)))
                x, y = seen
                get = (lambda lines: sums(x, y, lines)) if whole is None else (lambda lines: [s[lines] for s in whole])  # noqa: B023
                yield from pairs(a, b, get, high == low)
                yield None

        yield from emit(frames())

    return p.mapInPandas(run, schema)


def added(whole: list | None, more: list) -> list:
    """Sums of pairs, whose keys may have become more."""
    if whole is None:
        return more
    for s, m in zip(whole, more, strict=True):
        m[: s.shape[0], : s.shape[1]] += s
    return more


def pair_correlations(df: DataFrame, key: str, at: str, value: str, block: int = BLOCK, span: int = SPAN, least: float | None = None, rows: int = 1) -> DataFrame:
    """Pearson correlation of each two keys over the times both have; null where a side doesn't vary.

    Keys are dealt to blocks, and the matrices of each two blocks give the sums of all their pairs as products. With `least`, only
    pairs correlated that much over at least `rows` times go out.
    """
    kind = dict(df.dtypes)[key]

    def emit(frames):
        for f in frames:
            if f is not None:
                yield f if least is None else f[(f["corr"] >= least) & (f["n"] >= rows)]

    out = _pair_blocks(df, key, at, value, block, span, emit, f"a {kind}, b {kind}, n long, corr double")
    return out.withColumn("corr", F.nanvl("corr", F.lit(None).cast("double")))


def best_partners(df: DataFrame, key: str, at: str, value: str, digits: int = 6, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(key, partner, corr): the other key each key is correlated most with, rounded first; ties go to the smaller name, and nulls come last.

    Every two blocks give one candidate a key, so that pairs never leave their part.
    """
    kind = dict(df.dtypes)[key]

    def emit(frames):
        best: list = []
        for f in frames:
            if f is None:
                yield top(pd.concat(best)) if best else pd.DataFrame({"key": [], "partner": [], "corr": []})
                best = []
            else:
                c = np.round(f["corr"].to_numpy() + 1e-9, digits)
                both = pd.DataFrame({"key": np.r_[f["a"], f["b"]], "partner": np.r_[f["b"], f["a"]], "corr": np.r_[c, c]})
                best = [top(pd.concat([*best, both]))]

    def top(x: pd.DataFrame) -> pd.DataFrame:
        """Each key's highest, then smallest partner."""
        k, names = pd.factorize(x["key"])
        c = x["corr"].fillna(-2.0).to_numpy()
        most = np.full(len(names), -3.0)
        np.maximum.at(most, k, c)
        x = x[c == most[k]]
        return x.sort_values("partner", kind="stable").drop_duplicates("key")

    c = _pair_blocks(df, key, at, value, block, span, emit, f"key {kind}, partner {kind}, corr double")
    order = F.struct(-F.coalesce(F.nanvl("corr", F.lit(-2.0)), F.lit(-2.0)), "partner")
    c = c.groupBy("key").agg(F.min_by(F.struct("partner", "corr"), order).alias("x"))
    return c.select(F.col("key").alias(key), "x.partner", F.nanvl("x.corr", F.lit(None).cast("double")).alias("corr"))


def null_safe_all(cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols])

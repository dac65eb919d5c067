"""Aggregates of studies: effective samples, clusters, deciles, ranks, drawdowns, variance ratios, exceedances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.moments import corr
from tidemark.operators.cross_section import average_rank


def mean_se(value: str) -> tuple[Column, Column]:
    return F.avg(value), F.stddev_samp(value) / F.sqrt(F.count(value))


def cluster_mean(df: DataFrame, by: list[str], cluster: Column, value: str) -> DataFrame:
    """Mean over rows, and its error from the means of clusters: n, clusters, mean, se."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, cluster.alias("_c")).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return c.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("clusters"), (F.sum("_s") / F.sum("_n")).alias("mean"), (F.stddev_samp("_m") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def cluster_slope(df: DataFrame, by: list[str], cluster: str, x: str, y: str) -> DataFrame:
    """Slope of y on x with a t-statistic robust to clusters: sums of squared per-cluster scores."""
    w = Window.partitionBy(*by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", F.col(x) - F.avg(x).over(w)).withColumn("_y", F.col(y) - F.avg(y).over(w))
    fit = d.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") * F.col("_x"))).alias("slope"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.count(F.lit(1)).alias("n"))
    parts = d.groupBy(*by, cluster).agg(F.sum(F.col("_x") * F.col("_y")).alias("_sxy"), F.sum(F.col("_x") * F.col("_x")).alias("_sxx")).join(fit, by)
    score = F.col("_sxy") - F.col("slope") * F.col("_sxx")
    out = parts.groupBy(*by).agg(F.first("slope").alias("slope"), F.first("n").alias("n"), (F.first("slope") / (F.sqrt(F.sum(score * score)) / F.first("_xx"))).alias("t_stat"))
    return out


def pearson(x: str, y: str) -> Column:
    """0 where there are fewer than three pairs or one side doesn't vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when((F.count(a) < 3) | (F.stddev_pop(a) < 1e-12) | (F.stddev_pop(b) < 1e-12), 0.0).otherwise(corr(a, b))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_a", average_rank(x, *by)).withColumn("_b", average_rank(y, *by))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("_a", "_b").alias("spearman"))


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """By the rank identity; 0.5 where one class is missing."""
    d = df.withColumn("_r", average_rank(score, *by))
    p, n = F.sum(F.col(label).cast("double")), F.count(F.lit(1))
    ranks = F.sum(F.when(F.col(label) == 1, F.col("_r")))
    return d.groupBy(*by).agg(n.alias("n"), F.when((p == 0) | (p == n), 0.5).otherwise((ranks - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def effective_t(corr: Column, n: Column, overlap: float) -> Column:
    """t of a correlation with n divided by how many rows a horizon overlaps; 0 with two or fewer effective rows."""
    eff = F.greatest(F.lit(1), F.floor(n / F.greatest(F.lit(1.0), F.lit(overlap))))
    r2 = F.least(corr * corr, F.lit(0.999999))
    return F.when(eff <= 2, 0.0).otherwise(corr * F.sqrt((eff - 2) / (1 - r2)))


def deciles(df: DataFrame, by: list[str], score: str, value: str, tie: str, buckets: int = 10) -> DataFrame:
    """Mean of value in each bucket of the score's order; the first n mod `buckets` buckets get the extra row."""
    return df.withColumn("bucket", F.ntile(buckets).over(Window.partitionBy(*by).orderBy(score, tie))).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def max_drawdown_of_sum(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Largest fall of the running sum from its highest value so far, 0 included."""
    o = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_s", F.sum(value).over(o)).withColumn("_top", F.greatest(F.lit(0.0), F.max("_s").over(o)))
    return d.groupBy(*by).agg(F.max(F.col("_top") - F.col("_s")).alias("max_drawdown"))


def variance_ratio(df: DataFrame, key: str, at: str, price: str, base: int, k: int) -> DataFrame:
    """Variance of k-step over k times the variance of one-step log returns, both of strided, not overlapping samples."""
    w = Window.partitionBy(key).orderBy(at)
    d = df.withColumn("_i", F.row_number().over(w) - 1)

    def steps(stride: int) -> DataFrame:
        s = d.where(F.col("_i") % stride == 0)
        return s.withColumn("_r", F.log(F.col(price) / F.lag(price).over(w))).groupBy(key).agg(F.var_samp("_r").alias(f"_v{stride}"), F.count("_r").alias(f"_n{stride}"))

    j = steps(base).join(steps(base * k), key)
    return j.select(key, F.col(f"_n{base * k}").alias("n"), (F.col(f"_v{base * k}") / (F.col(f"_v{base}") * k)).alias("ratio"))


def exceedances(df: DataFrame, key: str, value: str, levels: list[float]) -> DataFrame:
    """Share of standardised values beyond each level, over all keys, each standardised by its own mean and deviation."""
    w = Window.partitionBy(key)
    z = df.where(F.col(value).isNotNull()).select(((F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)).alias("z")).where("z is not null")
    one = z.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(F.abs("z") > x, 1.0).otherwise(0.0)).alias(f"_{k}") for k, x in enumerate(levels)])
    return one.select("n", F.inline(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"_{k}").alias("share")) for k, x in enumerate(levels)])))


def concentration(df: DataFrame, key: str, value: str, top: int) -> DataFrame:
    """Share of the total that the `top` keys with the largest sums make."""
    s = df.groupBy(key).agg(F.sum(value).alias("_s"))
    r = s.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_s"), key)))
    return r.agg(F.count(F.lit(1)).alias("keys"), F.sum("_s").alias("total"), (F.sum(F.when(F.col("_r") <= top, F.col("_s"))) / F.sum("_s")).alias("top_share"))


def purged_split(df: DataFrame, by: list[str], at: str, purge: int, train: float = 0.7, valid: float = 0.0) -> DataFrame:
    """df with `part`: of each series' rows in time the first share is train, then valid (if any), then test; the `purge` rows after a cut belong to none."""
    w = Window.partitionBy(*by)
    i, n = F.row_number().over(w.orderBy(at)), F.count(F.lit(1)).over(w)
    one, two = F.floor(n * train), F.floor(n * round(train + valid, 12))
    part = F.when(i <= one, "train")
    if valid:
        part = part.when((i > one + purge) & (i <= two), "valid")
    return df.withColumn("part", part.when(i > two + purge, "test").otherwise("purged"))


def calendar_split(df: DataFrame, at: str, horizon: int, train: float = 0.7) -> DataFrame:
    """df with `part` by one time for all series: the order statistic of all rows' times at a share of them.

    Test starts there; train ends a horizon earlier. Times are counted before they are put in order, so the order is
    over distinct times.
    """
    times = df.groupBy(F.col(at).alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_t"))  # one row a time
    n = F.sum("_c").over(Window.partitionBy())
    cut = times.select("_t", before.alias("_s"), F.least(n - 1, F.floor(n * train)).alias("_i")).where("_s > _i").agg(F.min("_t").alias("_cut"))
    part = F.when(F.col(at) >= F.col("_cut"), "test").when(F.col(at) + horizon <= F.col("_cut"), "train").otherwise("purged")
    return df.join(F.broadcast(cut)).withColumn("part", part).drop("_cut")


def standardise(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """cols by the mean and population deviation of the training rows only; a deviation of 0 is 1."""
    stats = df.where(train).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    out = df.join(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0))
    return out.drop(*[f"_{n}_{c}" for c in cols for n in ("m", "s")])


def simple_ridge(df: DataFrame, by: list[str], x: str, y: str, alpha: float) -> DataFrame:
    """Ridge of y on one standardised feature with a free intercept, by group, from sums: intercept, coef."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"))
    coef = F.col("c") * F.col("n") / (F.col("v") * F.col("n") + alpha)
    return s.select(*by, "n", coef.alias("coef"), (F.col("my") - coef * F.col("mx")).alias("intercept"))


def settlement_hours(rates: DataFrame, key: str, ts: str, least: int = 3) -> DataFrame:
    """(key, gaps, hours): median hours between successive settlements of keys with at least `least` gaps."""
    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    g = rates.select(key, ts).distinct().withColumn("gap", gap).where("gap is not null")
    return g.groupBy(key).agg(F.count(F.lit(1)).alias("gaps"), (F.median("gap") / 3_600_000).alias("hours")).where(F.col("gaps") >= least)


def spread_statistics(touches: DataFrame, key: str, gate_bps: float, least: int = 100) -> DataFrame:
    """(key, n, p25, median, p75, above): quartiles of the spread in bps and the share at or above the gate; keys with fewer rows go."""
    s = touches.where("bid > 0 and ask > bid").select(key, ((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 1e4).alias("s"))
    q = [F.percentile("s", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    return s.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *q, F.avg(F.when(F.col("s") >= gate_bps, 1.0).otherwise(0.0)).alias("above")).where(F.col("n") >= least)


def equity_path(returns: DataFrame, key: str, ts: str, net_bps: str) -> DataFrame:
    """(key, n, equity, max_drawdown): compounded net returns, each floored at a total loss, and the deepest fall from a peak as a share of it."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    step = F.greatest(F.lit(-1.0), F.col(net_bps) / 1e4)
    lost = F.max(F.when(step <= -1, 1).otherwise(0)).over(w) == 1
    e = returns.where(F.col(net_bps).isNotNull()).withColumn("equity", F.when(lost, 0.0).otherwise(F.exp(F.sum(F.when(step > -1, F.log1p(step))).over(w))))
    e = e.withColumn("fall", 1 - F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return e.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by("equity", ts).alias("equity"), F.max("fall").alias("max_drawdown"))


def carry_outcomes(rates: DataFrame, key: str, ts: str, bps: str, hold_ms: int, cost_bps: float) -> DataFrame:
    """(key, n, median, p5, worst, best, profitable): what a carry entered at each settlement earns by hold_ms later.

    An entry earns the settlements after it up to and including its exit, less the cost; entries whose exit lies beyond
    the last settlement go. p5 is the value at place int(0.05 * (n - 1)) in order.
    """
    over = Window.partitionBy(key)
    r = rates.groupBy(key, ts).agg(F.sum(bps).alias("b"))
    r = r.withColumn("net", F.coalesce(F.sum("b").over(over.orderBy(ts).rangeBetween(1, hold_ms)), F.lit(0.0)) - cost_bps)
    r = r.withColumn("last", F.max(ts).over(over)).where(F.col(ts) + hold_ms <= F.col("last"))
    r = r.withColumn("i", F.row_number().over(over.orderBy("net")) - 1).withColumn("n", F.count(F.lit(1)).over(over))
    fifth = F.max(F.when(F.col("i") == F.floor(0.05 * (F.col("n") - 1)), F.col("net"))).alias("p5")
    return r.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median("net").alias("median"), fifth, F.min("net").alias("worst"), F.max("net").alias("best"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("profitable"))


def panel_geometry(panel: DataFrame, at: str) -> DataFrame:
    """(n, times, spacing, width): rows, distinct times, mean spacing of times and rows a time."""
    times = panel.groupBy(at).agg(F.count(F.lit(1)).alias("c"))
    return times.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("times"), ((F.max(at) - F.min(at)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("spacing"), F.avg("c").alias("width"))


def logistic(df: DataFrame, features: list[str], label: str, l2: float, iterations: int = 25, tolerance: float = 1e-8) -> DataFrame:
    """(feature, coef) of a ridge-penalised logistic regression by Newton steps; the intercept isn't penalised.

    A step is one aggregation over the rows; the driver sees the gradient and the Hessian, whose size is that of the features squared.
    """
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    names, rows = ["intercept", *features], df.dropna(subset=[*features, label])
    w, penalty = np.zeros(len(x)), np.diag([0.0] + [l2] * len(features))
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    for _ in range(iterations):
        p = 1 / (1 + F.exp(-sum((float(c) * v for c, v in zip(w, x, strict=True)), F.lit(0.0))))
        scored = rows.select(*[v.alias(f"_x{i}") for i, v in enumerate(x)], (F.col(label).cast("double") - p).alias("_e"), F.greatest(p * (1 - p), F.lit(1e-12)).alias("_s"))
        got = scored.agg(*[F.sum(F.col(f"_x{i}") * F.col("_e")) for i in range(len(x))], *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}") * F.col("_s")) for i, j in pairs]).first()
        if got[0] is None:
            break
        hessian = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, got[len(x) :], strict=True):
            hessian[i, j] = hessian[j, i] = v
        step = np.linalg.solve(hessian + penalty, np.array(got[: len(x)]) - penalty @ w)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, w, strict=True)], "feature string, coef double")


def global_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with `out`, the 1-based rank of value among all rows of a group, ties at their mean; for groups no single task can sort.

    Equal values are counted first. Distinct values fall into buckets of about six percent of their size, by a fixed rule
    that keeps their order; each bucket is summed by itself and starts where the buckets before it, one row each, end.
    Rows without a value get no rank.
    """
    v = F.col(value)
    bucket = (F.signum(v) * F.floor(F.log1p(F.abs(v) * 1e6) * 16)).alias("_bucket")
    counts = df.where(v.isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).select(*by, value, "_n", bucket)
    totals = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("_sum", inside).join(totals, [*by, "_bucket"]).select(*by, value, (F.col("_before") + F.col("_sum") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, [*by, value], "left")

"""Reports and event studies: what followed an event, what a score earned, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.moments import corr
from tidemark.functions.draws import digest, drawn
from tidemark.functions.ieee import ln, ratio
from tidemark.operators import joins
from tidemark.operators import windows as W
from tidemark.operators.statistics import effective_t, global_rank, pearson


def ic_report(df: DataFrame, features: list[str], target: str, overlap: float) -> DataFrame:
    """Per feature: n, Pearson, Spearman, t with effective rows, and whether it is large enough to suspect a leak."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.explode(pairs).alias("p")).select("y", "p.feature", "p.x").where("x is not null")
    ranked = global_rank(global_rank(long, ["feature"], "x", "_a"), ["feature"], "y", "_b")
    out = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("pearson"), pearson("_a", "_b").alias("spearman"))
    return out.withColumn("t_stat", effective_t(F.col("pearson"), F.col("n"), overlap)).withColumn("suspicious", F.abs("pearson") > 0.2)


def binomial_tail(successes: Column, trials: Column) -> Column:
    """P(X >= successes) of a fair coin's `trials`; terms by recurrence, all in the JVM."""
    # Terms count from the middle one, set to 1: counted from the first, 0.5^trials, they all vanish beyond 1,074 trials.
    upper = successes * 2 >= trials
    least = F.when(upper, successes).otherwise(trials - successes + 1)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("tail"), F.lit(0.0).alias("half"))

    def step(acc: Column, i: Column) -> Column:
        tail = acc["tail"] + F.when(i >= least, acc["term"]).otherwise(0.0)
        return F.struct((acc["term"] * (trials - i) / (i + 1)).alias("term"), tail.alias("tail"), (acc["half"] + acc["term"]).alias("half"))

    middle = F.floor((trials + 1) / 2)
    share = F.aggregate(F.sequence(middle, trials.cast("long")), start, step, lambda a: a["tail"] / (2 * a["half"] - F.when(trials % 2 == 0, 1.0).otherwise(0.0)))
    return F.when(upper, share).otherwise(1 - share)


def sign_agreement(df: DataFrame, by: str, features: list[str], target: str) -> DataFrame:
    """Per feature: in how many groups its correlation with the target is positive, and the chance of so one-sided a count."""
    per = df.groupBy(by).agg(*[pearson(f, target).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("c")) for f in features])
    n = per.select(F.explode(pairs).alias("p")).groupBy("p.feature").agg(F.sum(F.when(F.col("p.c") > 0, 1).otherwise(0)).alias("positive"), F.count(F.lit(1)).alias("groups"), F.avg("p.c").alias("mean"))
    return n.withColumn("chance", F.least(F.lit(1.0), 2 * binomial_tail(F.greatest("positive", F.col("groups") - F.col("positive")), F.col("groups"))))


def economic_test(df: DataFrame, by: list[str], score: str, value: str, cost_bps: float) -> DataFrame:
    """Top and bottom tenth of a score against the drift: what each side earns in excess of it, and whether that clears the cost."""
    cuts = df.groupBy(*by).agg(F.percentile(score, 0.9).alias("_q9"), F.percentile(score, 0.1).alias("_q1"))
    s, v = F.col(score), F.col(value)
    out = df.join(cuts, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("drift"), F.avg(F.when(s >= F.col("_q9"), v)).alias("top"), F.avg(F.when(s <= F.col("_q1"), v)).alias("bottom"))
    out = out.withColumn("long_edge", F.col("top") - F.col("drift")).withColumn("short_edge", F.col("drift") - F.col("bottom"))
    return out.withColumn("tradeable", F.greatest("long_edge", "short_edge") > cost_bps)


def run_summary(periods: DataFrame, by: list[str], per_year: float) -> DataFrame:
    """Of periods (net, turnover, market): mean, error, Sharpe ratio, hit rate, and what is left once the market it carries is paid for."""
    n, mean, sd = F.count("net"), F.avg("net"), F.stddev_samp("net")
    a = periods.groupBy(*by).agg(n.alias("periods"), mean.alias("net"), sd.alias("sd"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("hit"), F.avg("turnover").alias("turnover"), F.covar_samp("net", "market").alias("_c"), F.var_samp("market").alias("_v"), F.avg("market").alias("_m")).where("periods >= 2")
    err = F.col("sd") / F.sqrt("periods")
    beta = F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).otherwise(0.0)
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("sd") * F.col("sd") - 2 * F.col("beta") * F.col("_c") + F.col("beta") * F.col("beta") * F.col("_v")) / F.col("periods"))
    a = a.withColumn("sharpe", F.when(F.col("sd") > 0, F.col("net") / F.col("sd") * F.sqrt(F.lit(per_year))).otherwise(0.0)).withColumn("t_stat", F.when(err > 0, F.col("net") / err).otherwise(0.0)).withColumn("lo", F.col("net") - 1.96 * err).withColumn("hi", F.col("net") + 1.96 * err)
    a = a.withColumn("beta", beta).withColumn("alpha", F.col("net") - F.col("beta") * F.col("_m")).withColumn("_e", residual)
    return a.withColumn("alpha_t", F.when(F.col("_e") > 0, F.col("alpha") / F.col("_e")).otherwise(0.0)).drop("_c", "_v", "_m", "_e")


def capacity(weights: DataFrame, volumes: DataFrame, at: str, key: str, participation: float) -> DataFrame:
    """Per time: the gross size at which the tightest name would be `participation` of its volume."""
    j = weights.where("weight <> 0").join(volumes.where("volume > 0"), [at, key])
    return j.groupBy(at).agg(F.min(participation * F.col("volume") / (F.abs("weight") / 2)).alias("ceiling"), F.count(F.lit(1)).alias("names"))


def autocorrelations(df: DataFrame, key: str, at: str, value: str, lags: list[int], least: int = 30) -> DataFrame:
    """Per lag: correlation of a series with itself, averaged over the keys with more than `least` values."""
    o = W.ordered(key, at)
    d = df.select(key, value, F.count(value).over(Window.partitionBy(key)).alias("_n"), *[F.lag(value, k).over(o).alias(f"_{k}") for k in lags]).where(F.col("_n") > least)
    per = d.groupBy(key).agg(*[corr(value, f"_{k}").alias(f"_{k}") for k in lags])
    return per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("c")) for k in lags])).alias("p")).groupBy("p.lag").agg(F.count("p.c").alias("keys"), F.avg("p.c").alias("corr"))


def blocks(df: DataFrame, key: str, at: str, value: str, length: int) -> DataFrame:
    """Sums over `length` rows in a row; a ragged tail is dropped."""
    i = F.row_number().over(W.ordered(key, at)) - 1
    return df.withColumn("block", F.floor(i / length)).groupBy(key, "block").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == length).drop("_n")


def markouts(fills: DataFrame, touches: DataFrame, key: str, horizons_ms: list[int]) -> DataFrame:
    """Per side and horizon: n, mean and error of where the mid stood after a fill against the fill's price, in bps of the mid then."""
    mids = touches.select(key, "ts", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    f = joins.asof_backward(fills.withColumnRenamed("ts", "quoted").withColumnRenamed("fill_ts", "ts"), mids, key, ["mid"], keep_unmatched=False).withColumnRenamed("r_mid", "mid0").drop("r_ts")
    f = f.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons_ms]))).withColumn("ts", F.col("ts") + F.col("horizon"))
    f = joins.asof_backward(f, mids, key, ["mid"], keep_unmatched=False)
    gain = ratio(F.when(F.col("side") == "bid", F.col("r_mid") - F.col("price")).otherwise(F.col("price") - F.col("r_mid")), "mid0") * 1e4
    return f.withColumn("_g", gain).groupBy("side", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("_g").alias("mean"), (F.stddev_samp("_g") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def cancel_share(touches: DataFrame, trades: DataFrame, key: str) -> DataFrame:
    """Per key and side: the share of the size that left an unchanged touch without having been traded there."""
    o = Window.partitionBy(key).orderBy("ts", "seq")

    def one(side: str, px: str, sz: str, hits: Column) -> DataFrame:
        q = touches.withColumn("_px", F.lead(px).over(o)).withColumn("_sz", F.lead(sz).over(o))
        q = q.withColumn("depleted", F.when((F.col("_px") == F.col(px)) & (F.col("_sz") < F.col(sz)), F.col(sz) - F.col("_sz")).otherwise(0.0))
        t = joins.asof_backward(trades.where(hits), q.withColumn("id", F.col("seq")), key, ["id", px], keep_unmatched=False)
        at = t.where(F.abs(F.col("price") - F.col(f"r_{px}")) <= F.abs(f"r_{px}") * 1e-9).groupBy(F.col("r_id").alias("seq")).agg(F.sum("size").alias("traded"))
        j = q.where("depleted > 0").join(at, "seq", "left").fillna(0.0, ["traded"])
        return j.groupBy(key, F.lit(side).alias("side")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.greatest(F.lit(0.0), F.col("depleted") - F.col("traded"))) / F.sum("depleted")).alias("share"))

    return one("bid", "bid", "bid_sz", ~F.col("is_buy")).unionByName(one("ask", "ask", "ask_sz", F.col("is_buy")))


def grid_asof(df: DataFrame, key: str, step: int, values: list[str], stale_ms: int) -> DataFrame:
    """Every key's last values at each step of one common grid, as long as they are not older than stale_ms."""
    ends = df.agg((F.floor(F.min("ts") / step) * step).alias("_a"), (F.floor(F.max("ts") / step) * step).alias("_b"))
    grid = df.select(key).distinct().join(F.broadcast(ends)).select(key, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias("ts"))
    return joins.asof_backward(grid, df, key, values, keep_unmatched=False).where(F.col("ts") - F.col("r_ts") <= stale_ms)


def lag_slopes(grid: DataFrame, key: str, leader, value: str, step: int, ahead: list[int]) -> DataFrame:
    """Per follower and horizon: slope and correlation of its coming change in bps on its gap to the leader now."""
    lead = grid.where(F.col(key) == leader).select("ts", F.col(value).alias("_lead"))
    o = W.ordered(key)
    f = grid.where(F.col(key) != leader).withColumns({f"_f{k}": F.when(F.lead("ts", k).over(o) == F.col("ts") + k * step, ln(ratio(F.lead(value, k).over(o), value)) * 1e4) for k in ahead})
    j = f.join(lead, "ts").withColumn("gap", ln(ratio("_lead", value)) * 1e4)
    long = j.select(key, "gap", F.explode(F.array(*[F.struct(F.lit(k).alias("ahead"), F.col(f"_f{k}").alias("y")) for k in ahead])).alias("p")).select(key, "gap", "p.ahead", "p.y").where("y is not null")
    return long.groupBy(key, "ahead").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "gap").alias("slope"), pearson("gap", "y").alias("corr"))


def event_path(events: DataFrame, panel: DataFrame, key: str, at: str, value: str, offsets: list[int], by: list[str]) -> DataFrame:
    """Mean of a value at offsets around events (key, at, *by), clustered on nothing: n, mean and error."""
    e = events.withColumn("offset", F.explode(F.array(*[F.lit(k) for k in offsets]))).withColumn("_t", F.col(at) + F.col("offset")).drop(at)
    p = panel.select(F.col(key), F.col(at).alias("_t"), F.col(value).alias("_v")).where("_v is not null")
    return e.join(p, [key, "_t"]).groupBy(*by, "offset").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), (F.stddev_samp("_v") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def best_partner(pairs: DataFrame, key: str) -> DataFrame:
    """(key, partner, corr): the other name a name moves most with; ties go to the smaller name."""
    both = pairs.select(F.col("a").alias(key), F.col("b").alias("partner"), "corr").unionByName(pairs.select(F.col("b").alias(key), F.col("a").alias("partner"), "corr"))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("corr"), "partner"))).where("_r = 1").drop("_r")


def block_bootstrap(values: DataFrame, at: str, value: str, length: int, draws: int, seed: int) -> DataFrame:
    """Mean and 95 % interval of a series' mean from `draws` resamples of blocks of `length` rows in a row.

    One row a period is small next to the data it comes from; positions are numbered in one task. Starts come from a
    hash of seed, draw and block, so reruns agree.
    """
    v = values.select(F.col(at), F.col(value).alias("_v")).where("_v is not null").withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at)) - 1)
    n = v.agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("mean"))
    spark = values.sparkSession
    picks = spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(n)).where(F.col("_n") >= length).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / length))))
    start = drawn(F.col("_n") - length + 1, F.lit(seed), "draw", "_b")
    rows = picks.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).where(F.col("_b") * length + F.col("_k") < F.col("_n")).select("draw", "_n", "mean", (start + F.col("_k")).alias("_i"))
    means = rows.join(v, "_i").groupBy("draw").agg(F.avg("_v").alias("_m"), F.first("mean").alias("mean"), F.first("_n").alias("_n"))
    return means.agg(F.first("_n").alias("n"), F.first("mean").alias("mean"), F.percentile("_m", 0.025).alias("lo"), F.percentile("_m", 0.975).alias("hi"), F.count(F.lit(1)).alias("draws"))


def shuffled_scores(df: DataFrame, at: str, key: str, score: str, seed: int) -> DataFrame:
    """df with the scores of each time dealt to its names anew: a control that keeps everything but who had which score."""
    own = F.row_number().over(Window.partitionBy(at).orderBy(key))
    dealt = F.row_number().over(Window.partitionBy(at).orderBy(digest(F.lit(seed), at, key), key))
    d = df.where(F.col(score).isNotNull()).withColumn("_i", own).withColumn("_j", dealt)
    other = d.select(at, F.col("_j").alias("_i"), F.col(score).alias("shuffled"))
    return d.join(other, [at, "_i"]).drop("_i", "_j")


def decimated(df: DataFrame, at: str, stride: int) -> DataFrame:
    """Rows of every stride-th distinct time."""
    times = df.select(at).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at)) - 1)
    return df.join(times.where(F.col("_k") % stride == 0).drop("_k"), at, "left_semi")


def tranche_book(books: DataFrame, at: str, key: str, hold: int) -> DataFrame:
    """(at, key, weight): a book split into `hold` tranches, one renewed each time; a time's weight is the mean of the last `hold` books.

    Times before the first `hold` books are left out; a book without a name counts it as nothing.
    """
    start = books.agg((F.min(at) + hold - 1).alias("_a"), F.max(at).alias("_b"))
    held = books.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(hold - 1)))).select((F.col(at) + F.col("_k")).alias(at), key, "weight")
    return held.join(F.broadcast(start)).where(F.col(at).between(F.col("_a"), F.col("_b"))).groupBy(at, key).agg((F.sum("weight") / hold).alias("weight"))


def by_tercile(df: DataFrame, regime: str, value: str) -> DataFrame:
    """Mean and error of a value in the low, middle and high third of a regime variable."""
    cuts = df.agg(F.percentile(regime, 1 / 3).alias("_p"), F.percentile(regime, 2 / 3).alias("_q"))
    third = F.when(F.col(regime) <= F.col("_p"), "low").when(F.col(regime) <= F.col("_q"), "middle").otherwise("high")
    d = df.where(F.col(regime).isNotNull() & F.col(value).isNotNull()).join(F.broadcast(cuts)).groupBy(third.alias("third"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"))

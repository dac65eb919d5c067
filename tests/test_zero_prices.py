"""Prices of zero: ratios and logarithms are infinite or no numbers, as SQL has them, and nothing stops."""

import math

from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions import sql_functions
from tidemark.operators import fades as E
from tidemark.operators import research as R
from tidemark.operators import studies as T
from tidemark.operators import universe
from tidemark.operators import venues as N
from tidemark.operators import windows as W

INF = float("inf")
BAR = "s string, ts long, open double, high double, low double, close double"
DAY = 86_400_000


def test_bar_features_of_a_zero_low(spark):
    b = spark.createDataFrame([("s", 1, 2.0, 0.0), ("s", 2, 2.0, 1.0)], "s string, ts long, high double, low double")
    assert [r.p for r in b.orderBy("ts").select(M.parkinson_bps("high", "low").alias("p")).collect()][0] == INF
    c = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 0.0), ("s", 3, 4.0)], "s string, ts long, close double")
    got = [r.m for r in c.withColumn("m", W.ma_distance(W.ordered("s"), "close", 1)).orderBy("ts").collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2] == math.log(2) * 1e4


def test_lead_trade_at_a_zero_ask(spark):
    g = spark.createDataFrame([(0, 0, 10.0, 10.0), (4, 0, 0.0, 0.0), (4, 1, 5.0, 6.0)], "inst int, ts long, bid double, ask double")
    (t,) = N.lead_trades(g, "inst", 0, 1, 6.0, 1.0).collect()
    assert (t.side, t.entry, t.net_mid, t.net_touch) == (1, 0.0, INF, INF)


def test_markout_against_a_zero_mid(spark):
    fills = spark.createDataFrame([("a", 0, "bid", 1.0, 5)], "inst string, ts long, side string, price double, fill_ts long")
    touches = spark.createDataFrame([("a", 1, 1, 0.0, 0.0), ("a", 10, 2, 3.0, 3.0)], "inst string, ts long, seq long, bid double, ask double")
    got = {r.horizon: (r.n, r["mean"]) for r in T.markouts(fills, touches, "inst", [1, 10]).collect()}
    assert got == {1: (1, -INF), 10: (1, INF)}


def test_realised_vol_through_a_zero_mid(spark):
    m = spark.createDataFrame([("a", 1000, 1.0), ("a", 2000, 0.0), ("a", 3000, 1.0)], "k string, ts long, mid double")
    assert [r.rv for r in W.realised_vol(m, "k", 10_000).orderBy("ts").collect()] == [0.0, 0.0, INF]


def test_range_dataset_of_a_zero_low(spark):
    rows = [("s", k, 2.0, 3.0, 0.0 if k == 8 else 1.0 + k / 100, 2.0) for k in range(13)]
    got = {r.ts: r for r in universe.range_dataset(spark.createDataFrame(rows, BAR), "s", 1, 2, 2).collect()}
    assert set(got) == {8, 9, 10}
    assert got[9].log_width == got[9].parkinson == got[9].dist_low == INF and got[9].trend_ratio == 0 and math.isnan(got[9].width_ratio)
    assert got[8].dist_low < INF


def test_tick_returns_to_and_from_a_zero_mid(spark):
    t = spark.createDataFrame([("a", k, k, p, p) for k, p in enumerate((1.0, 0.0, 0.0, 1.0))], "k string, ts long, seq long, bid double, ask double")
    a, b, c, d = (r.ret for r in R.lagged_returns(t, "k", 1).orderBy("ts").collect())
    assert (a, b, d) == (0.0, -INF, INF) and math.isnan(c)


def test_lag_slope_over_a_zero_mid(spark):
    mids = {0: (1.0, 1.1, 1.2, 1.3, 1.2), 4: (1.0, 1.2, 0.0, 1.1, 1.3), 5: (1.0, 1.2, 1.1, 1.1, 1.3)}
    g = spark.createDataFrame([(i, k, m) for i, x in mids.items() for k, m in enumerate(x)], "inst int, ts long, mid double")
    got = {r.inst: r for r in T.lag_slopes(g, "inst", 0, "mid", 1, [1]).collect()}
    assert got[4].n == got[5].n == 4 and math.isnan(got[4].slope) and math.isnan(got[4]["corr"]) and math.isfinite(got[5].slope)


def _bar_a_day(spark):
    """Shuffling inside days leaves these bars as they are."""
    return spark.createDataFrame([("s", (k + 1) * DAY, 5.0, 6.0, 0.0 if k == 2 else 4.0, 5.0) for k in range(6)], BAR)


def test_shuffled_bars_keep_a_zero_low(spark):
    got = [r.low for r in E.shuffled_bars(_bar_a_day(spark), "s", 7).orderBy("ts").collect()]
    assert got[2] == 0.0 and all(abs(x - 4.0) < 1e-9 for k, x in enumerate(got) if k != 2)


def test_shuffled_control_ranges_over_a_zero_low(spark):
    b = _bar_a_day(spark).withColumn("open", F.when(F.col("ts") == 4 * DAY, 1.0).otherwise(F.col("open")))
    run = [E.Fade("r", 3, 2)]
    real, control = (sorted((r.ts, r.side, round(r.fill, 9)) for r in E.candidates(x, "s", run, E.Costs(), False).collect()) for x in (b, E.shuffled_bars(b, "s", 7)))
    assert real and real == control


def test_log_blend_with_a_zero(spark):
    sql_functions.register(spark)
    assert tuple(spark.sql("SELECT log_blend(2D, 0D, 0.5D), log_blend(0D, 2D, 0.5D), round(log_blend(4D, 1D, 0.5D), 9)").first()) == (0.0, 0.0, 2.0)

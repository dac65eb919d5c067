"""The venue operators on fixtures worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import statistics as S
from tidemark.operators import venues as N


def test_titles(spark):
    t = spark.createDataFrame([("Binance Will List A (AA) and B (BB)",), ("Binance Futures Will Launch AAUSDT and 1000BUSDT",), ("Binance Alpha Will List C (CC)",), ("Binance Will List (X) Alpha",), ("Maintenance (DD)",), (None,)], "title string")
    got = sorted((r.kind, r.ticker) for r in N.announced(t, "title").collect())
    assert got == [("futures", "1000B"), ("futures", "AA"), ("spot", "AA"), ("spot", "BB")]
    inst = spark.createDataFrame([("1000AA-USDT",), ("10000AA-USDT",), ("BB-USDT",)], "inst_id string")
    coins = spark.createDataFrame([("AA",), ("BB",), ("CC",)], "ticker string")
    assert {r.ticker: r.inst_id for r in N.traded_as(coins, "ticker", inst).collect()} == {"AA": "1000AA-USDT", "BB": "BB-USDT", "CC": None}


def test_screen_gives_every_reason(spark):
    i = spark.createDataFrame([("A-USDT", 0.01, 1.0, "live"), ("B-USDT", 1.0, None, "suspend")], "inst_id string, tick double, contract double, state string")
    t = spark.createDataFrame([("A-USDT", 100.0, 99.95, 100.05, 1e6), ("B-USDT", 100.0, 0.0, 101.0, 1.0), ("C-USDT", 1.0, 1.0, 1.0, 1.0), ("A-USDC", 1.0, 1.0, 1.0, 1.0)], "inst_id string, last double, bid double, ask double, volume double")
    lead = spark.createDataFrame([("AUSDT", 1e9)], "symbol string, lead_volume double")
    got = {r.inst_id: r for r in N.screen(i, t, lead, 1e6, 1e6, 5.0, 0.5, 3.0).collect()}
    assert set(got) == {"A-USDT", "B-USDT"} and got["A-USDT"].reasons == [] and got["A-USDT"].spread_ticks == pytest.approx(10)
    assert got["B-USDT"].reasons == ["not live", "coarse tick", "narrow", "thin", "no leader"]


def test_candles_of_either_shape(spark):
    texts = ['{"time":"5","open":"1.5","high":2,"low":"1","close":""}', '["6","1","2","0.5","1.5","9"]', '["6","1","2"]', '{"ts":"x","open":1}', '{"ts":7,"open":"z"}', "junk", None]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    c = N.candle("t")
    got = {r.k: (r.ts, r.open and float(r.open), float(r.close) if r.close is not None else None) for r in d.select("k", *[x.alias(n) for n, x in c.items()]).collect()}
    assert got[0] == (5, 1.5, 0.0) and got[1] == (6, 1.0, 1.5) and all(got[k] == (None, None, None) for k in (2, 3, 4, 5, 6))


def test_ticker_price(spark):
    d = spark.createDataFrame([('{"last":"0","markPrice":"3"}',), ('{"price":2}',), ("{}",)], "t string")
    assert sorted(float(r[0] or 0) for r in d.select(N.ticker_price("t")).collect()) == [0.0, 2.0, 3.0]


def test_fee_ladder_faults(spark):
    assert N.ladder_faults(N.fee_schedule(spark)).count() == 0
    bad = N.fee_schedule(spark, {0: (2.0, 6.0), 1: (2.0, 6.0), 2: (1.0, 7.0), 3: (1.0, 5.0)})
    assert {r.tier: r.fault for r in N.ladder_faults(bad).collect()} == {1: "same", 2: "worse"}


def test_time_order(spark):
    d = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("a", 3, 20), ("a", 4, 30)], "k string, n int, ts long")
    assert {r.n: (r.place, r.late) for r in N.time_order(d, "k", "n", "ts").collect()} == {1: (1, False), 2: (3, False), 3: (2, True), 4: (4, False)}


def test_depth_state(spark):
    a = spark.createDataFrame([("a", 0, 0), ("a", 5, 1), ("a", 9, 2)], "k string, ts long, seq long")
    d = spark.createDataFrame([("a", 4, 0, 3.0, 1.0), ("a", 8, 1, 8.0, 8.0)], "k string, ts long, seq long, neg_1 double, pos_1 double")
    got = {r.ts: r for r in N.depth_state(a, d, "k", ("1",)).collect()}
    assert set(got) == {5, 9} and got[5].depth_imb_1 == 0.5 and got[5].depth_total_ln == 0.0
    assert got[9].depth_age_s == 0.001 and got[9].depth_total_ln == pytest.approx(math.log(4))


def test_lead_trades_one_at_a_time(spark):
    rows = [("lead", t, 110.0, 110.0) for t in range(6)] + [("f", t, 99.0 + t, 101.0 + t) for t in range(6)]
    g = spark.createDataFrame(rows, "k string, ts long, bid double, ask double")
    got = sorted((r.ts, r.side, r.entry, r.net_mid) for r in N.lead_trades(g, "k", "lead", 2, 1.0, 1.0).collect())
    assert [x[:3] for x in got] == [(0, 1, 101.0), (2, 1, 103.0)]
    assert got[0][3] == pytest.approx((102 - 101) / 101 * 1e4 - 2)


def test_period_stack(spark):
    a = spark.createDataFrame([(t, float(t)) for t in range(10)], "t long, net double")
    b = spark.createDataFrame([(t, 2.0 * t) for t in range(5, 15)], "t long, net double")
    s = N.period_stack({"a": N.aligned(a, "t", 3, 3), "b": N.aligned(b, "t", 3, 3)}, "t", "net")
    assert sorted((r.t, r.stack) for r in s.collect()) == [(6, 9.0), (9, 13.5)]


def test_predictions_out_of_step_are_refused(spark):
    r = spark.createDataFrame([("a", t, float(t)) for t in range(5)], "k string, t long, y double")
    p = spark.createDataFrame([("a", t, 2.0 * t) for t in range(5)], "k string, t long, prediction double")
    assert [tuple(x) for x in N.aligned_scores(r, p, "k", "t", "y").collect()] == [("a", 5, pytest.approx(1.0))]
    for bad in (p.where("t > 0"), p.withColumn("t", F.col("t") + 1), p.union(p.limit(1))):
        with pytest.raises(ValueError, match="out of step"):
            N.aligned_scores(r, bad, "k", "t", "y")


def test_premium_tails_by_hand(spark):
    d = spark.createDataFrame([(k, t, 100.0 * math.exp((0.01 if k == "a" else -0.01) * t), 1.0, 5.0 if k == "a" else 0.0) for k in ("a", "b") for t in range(6)], "k string, t long, close double, funding double, s double")
    (r,) = N.premium_tails(d, "k", "t", "close", "funding", "s", 1.0, 2, 4.0).collect()
    assert (r.tail, r.events, r.names) == ("above", 2, 1)  # held from 0 to 2, then from 3 on
    assert r.net == pytest.approx(200 - 2 - 8) and r.paid == 2.0


def test_made_up_paths_revert_or_walk(spark):
    """A variance ratio well under 1 for the path that reverts, near 1 for the walk; partitions don't change the draws."""
    ratio = lambda b: S.variance_ratio(b.withColumn("k", F.lit("x")), "k", "ts", "close", 1, 120).first()
    back, walk = N.ou_bars(spark, 6, 0.5, sub_steps=4), N.ou_bars(spark, 6, None, sub_steps=4)
    assert ratio(back).ratio < 0.6 and 0.75 < ratio(walk).ratio < 1.25
    one = {r.ts: r.close for r in back.collect()}
    assert one == {r.ts: r.close for r in N.ou_bars(spark, 6, 0.5, sub_steps=4).coalesce(1).collect()} and len(one) == 6 * 1440
    assert back.where("high < greatest(open, close) or low > least(open, close)").count() == 0

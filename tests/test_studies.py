"""Operators without SQL on fixtures worked out by hand, and files written and read again."""

import json
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import account, sequential
from tidemark.operators import statistics as S
from tidemark.operators import studies as T
from tidemark.sources import feeds, sinks


def test_correlation_of_a_series_that_stands_still(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert df.agg(S.pearson("x", "y")).first()[0] == 0.0
    assert df.agg(S.corr("x", "y")).first()[0] is None


def test_logistic_against_newton_steps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    a, w, pen = np.c_[np.ones(400), x], np.zeros(3), np.diag([0, 2.0, 2.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (y - p) - pen @ w)
    df = spark.createDataFrame([(float(u), float(v), float(z)) for (u, v), z in zip(x, y, strict=True)], "u double, v double, y double")
    got = {r.feature: r.coef for r in S.logistic(df, ["u", "v"], "y", 2.0).collect()}
    assert [got["intercept"], got["u"], got["v"]] == pytest.approx(list(w), abs=1e-6)
    assert {r.coef for r in S.logistic(df.limit(0), ["u"], "y", 1.0).collect()} == {0.0}


def test_block_bootstrap(spark):
    values = np.sin(np.arange(61) / 3) + 0.2
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "t long, v double")
    a, b = (T.block_bootstrap(df, "t", "v", 5, 400, seed).first() for seed in (3, 3))
    assert a == b and a.n == 61 and a.draws == 400 and a.mean == pytest.approx(values.mean()) and a.lo < a.mean < a.hi
    whole = T.block_bootstrap(df, "t", "v", 61, 5, 1).first()
    assert whole.lo == pytest.approx(values.mean()) and whole.hi == pytest.approx(values.mean())


def test_shuffled_scores_keep_each_times_values(spark):
    df = spark.createDataFrame([(t, s, float(10 * t + s)) for t in range(4) for s in range(6)] + [(9, 1, None)], "t long, symbol long, score double")
    rows = T.shuffled_scores(df, "t", "symbol", "score", 5).collect()
    assert len(rows) == 24 and any(r.score != r.shuffled for r in rows)
    for t in range(4):
        assert sorted(r.score for r in rows if r.t == t) == sorted(r.shuffled for r in rows if r.t == t)


def test_interleaved_keeps_the_net_near_zero(spark):
    legs = [("m", "a", "buy", 5.0), ("m", "b", "buy", 4.0), ("m", "c", "sell", 6.0), ("m", "d", "sell", 3.0)]
    rows = sorted(account.interleaved(spark.createDataFrame(legs, "run string, name string, side string, notional double"), "run", "name").collect(), key=lambda r: r.place)
    assert [(r.name, r.net_after) for r in rows] == [("a", 5.0), ("c", -1.0), ("b", 3.0), ("d", 0.0)]


def test_side_weights_redistribute_like_repeated_capping(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 12):
        risk = rng.uniform(1, 40, n)
        w, capped = 1 / risk / (1 / risk).sum(), np.zeros(n, bool)
        cap = max(0.2, 1 / n)
        for _ in range(50):
            over = w > cap * (1 + 1e-9)
            if not over.any():
                break
            capped |= over
            w[over] = cap
            free = ~capped
            if not free.any():
                break
            w[free] += (1 - w.sum()) * w[free] / w[free].sum()
        df = spark.createDataFrame([("s", f"{i:02}", float(r)) for i, r in enumerate(risk)], "side string, name string, risk double")
        got = [r.weight for r in account.side_weights(df, ["side"], "name", "risk", 0.2).orderBy("name").collect()]
        assert got == pytest.approx(list(w), abs=1e-9) and sum(got) == pytest.approx(1)


def test_an_order_that_shrinks_a_position_is_never_refused(spark):
    limits = {"spread_bps": 1.0, "leverage": 2.0, "order": 1.0, "cost_bps": 4.0, "position": 5.0, "notional": 10.0, "loss": 1.0, "buffer": 0.1, "mmr": 0.005}
    df = spark.createDataFrame([(1, -1, 3.0, 4.0), (2, -1, 5.0, 4.0), (3, 1, 3.0, 4.0)], "id int, side int, size double, position double")
    df = df.select("*", F.lit(10.0).alias("price"), F.lit(20.0).alias("leverage"), F.lit(0.0).alias("edge_bps"), F.lit(9.0).alias("spread_bps"), F.lit(-5.0).alias("unrealized"))
    got = {r.id: r.why for r in df.select("id", account.order_reasons(limits).alias("why")).collect()}
    assert got[1] == [] and "edge" in got[2] and {"position", "notional", "liquidation", "unrealized_loss"} <= set(got[3])


def test_snapshots_and_trades(spark, tmp_path):
    head = "timestamp," + ",".join(f"{s}[{i}].{f}" for s in ("asks", "bids") for i in range(2) for f in ("price", "amount"))
    (tmp_path / "book.csv").write_text(head + "\n1700000000000000,101,1,102,2,100,3,99,4\n1700000001000000,101,1,,,103,3,,\nbad,1,1,1,1,1,1,1,1\n")
    rows = feeds.read_snapshots(spark, str(tmp_path / "book.csv")).withColumn("why", feeds.implausible()).orderBy("ts").collect()
    assert [r.ts for r in rows] == [1700000000000, 1700000001000] and [len(r.asks) for r in rows] == [2, 1]
    assert rows[0].why == [] and rows[1].why == ["crossed"]
    (tmp_path / "t.csv").write_text("id,price,qty,time,is_buyer_maker\n1,10,2,1700000000000,true\n2,11,1,1700000000001,false\n3,11,1,1700000000002,maybe\n4,x,1,1700000000003,true\n")
    assert [(r.price, r.is_buy) for r in feeds.read_trades(spark, str(tmp_path / "t.csv")).orderBy("ts").collect()] == [(10.0, False), (11.0, True)]


def test_metrics_depth_and_panel(spark, tmp_path):
    (tmp_path / "m.csv").write_text("create_time,sum_open_interest\n1970-01-01 00:05:00,7\nnever,8\n1970-01-01 00:10:00,inf\n")
    assert [(r.ts, r.oi) for r in feeds.read_metrics(spark, str(tmp_path / "m.csv"), {"oi": "sum_open_interest"}).orderBy("ts").collect()] == [(300000, 7.0), (600000, None)]
    (tmp_path / "d.csv").write_text("timestamp,percentage,depth,notional\n1970-01-01 00:00:01,-1,5,50\n1970-01-01 00:00:01,0.2,6,60\n")
    r = feeds.depth_bands(spark, str(tmp_path / "d.csv")).first()
    assert (r.ts, r.neg_1, r.pos_0p2, r.pos_5) == (1000, 50.0, 60.0, None)
    (tmp_path / "p.csv").write_text("date,symbol,close,minutes,funding_bps,funding_periods\n2026-01-01,A,1.5,1440,2,3\n2026-01-02,A,oops,100,0,0\n")
    rows = feeds.read_panel(spark, str(tmp_path / "p.csv")).orderBy("date").collect()
    assert [(x.close, x.funding_bps, x.complete) for x in rows] == [(1.5, 2.0, True), (None, None, False)]


def test_json_lines_and_sinks(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(json.dumps({"coin": "X", "as_of_ms": 86400000}) + "\nnot json\n")
    maps = feeds.read_json_lines(spark, str(tmp_path / "log.jsonl"), "coin string, as_of_ms long")
    sinks.write_maps(maps, str(tmp_path / "maps"))
    back = spark.read.text(str(tmp_path / "maps")).first()
    assert json.loads(back.value) == {"coin": "X", "as_of_ms": 86400000} and str(back.day) == "1970-01-02"
    f = spark.createDataFrame([("i", 1, 2.0, 1), ("i", 2, 3.0, None)], "inst string, ts long, mid double, label_300s int")
    sinks.write_features(f, str(tmp_path / "features"), ["label_300s"])
    assert spark.read.parquet(str(tmp_path / "features")).count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_features(f, str(tmp_path / "features"), ["label_300s"])
    (tmp_path / "f.csv").write_text("ts,mid,vol_regime,is_valid,label_300s\n5,1.5,low_vol,true,-1\n")
    sinks.csv_to_parquet(spark, str(tmp_path / "f.csv"), str(tmp_path / "f.parquet"))
    assert [t for _, t in spark.read.parquet(str(tmp_path / "f.parquet")).dtypes] == ["bigint", "double", "string", "boolean", "bigint"]
    p = spark.createDataFrame([(2, "b", 1.0), (1, "a", float("nan")), (1, "b", 2.0)], "date int, symbol string, x double")
    sinks.write_panel(p, str(tmp_path / "panel"))
    assert spark.read.option("header", True).csv(str(tmp_path / "panel")).count() == 3
    assert [r.date for r in sinks.whole_cross_sections(p, "date", ["x"], 1).orderBy("date").collect()] == [1, 2]
    assert feeds.shared_columns([p, p.drop("x")]).columns == ["date", "symbol"]
    assert {r.symbol: r.spread_bps for r in feeds.with_spreads(p.where("date = 1"), spark.createDataFrame([("a", 3.0)], "symbol string, spread_bps double"), 9.0).collect()} == {"a": 3.0, "b": 9.0}


def test_within_day_shuffle_keeps_each_days_steps(spark):
    rng = np.random.default_rng(4)
    day, close = 86_400_000, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 96)))
    df = spark.createDataFrame([("a", (i + 1) * 3_600_000, float(c)) for i, c in enumerate(close)], "symbol string, ts long, close double")
    rows = sequential.within_day_shuffle(df, "symbol", 3).orderBy("ts").collect()
    was = np.diff(np.log([r.close for r in rows]), prepend=np.log(rows[0].close))
    now = np.diff(np.log([r.shuffled for r in rows]), prepend=0.0)
    for d in range(4):
        at = [i for i, r in enumerate(rows) if (r.ts - 1) // day == d]
        assert len(at) == 24 and sorted(was[at]) == pytest.approx(sorted(now[at]), abs=1e-9)
    assert not np.allclose(was, now)


def test_global_rank_is_the_average_rank(spark):
    rng = np.random.default_rng(6)
    values = [*rng.normal(0, 1000, 60), *rng.normal(0, 1e-4, 20), 0.0, 0.0, -0.0, 5.0, 5.0, 5.0, -7.0, -7.0]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", None)], "g string, v double")
    want = {v: (1 + sum(x < v for x in values) + sum(x <= v for x in values)) / 2 for v in values}
    rows = S.global_rank(df, ["g"], "v", "rank").collect()
    assert len(rows) == len(values) + 2 and all(r["rank"] == want[r.v] for r in rows if r.g == "g")
    assert {r.v: r["rank"] for r in rows if r.g == "h"} == {1.0: 1.0, None: None}


def test_binomial_tail_of_many_trials(spark):
    cases = [(3100, 6000), (2900, 6000), (3000, 6000), (5, 5), (0, 5), (3, 5), (1, 1), (0, 0), (60, 101)]
    d = spark.createDataFrame(cases, "s long, n long")
    got = {(r.s, r.n): r.p for r in d.withColumn("p", T.binomial_tail(F.col("s"), F.col("n"))).collect()}
    for s, n in cases:
        assert got[s, n] == pytest.approx(float(Fraction(sum(math.comb(n, i) for i in range(s, n + 1)), 2**n)), rel=1e-9)


def test_position_size_takes_the_chance_to_lose_as_written(spark):
    price, b = 19200.0 / 23.0, 10.0 / 80.0
    d = spark.createDataFrame([(price, 80.0, 10.0)], "price double, vol double, edge double")
    size, bound = account.position_size(F.lit(10000.0), 0.01, F.col("price"), F.col("vol"), F.col("edge"), 0.9, 0.25, 3.0, F.lit(2.0))
    assert tuple(d.select(size, bound).first()) == (10000.0 * ((0.9 * b - 0.1) / b * 0.25) * 3.0 / price, "kelly")

"""What grows with the table: plans and steps that large inputs need, on small ones."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import books as B
from tidemark.operators import joins, sequential
from tidemark.operators import research as R
from tidemark.operators import studies as T
from tidemark.plans import books as book_plans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clusters_of_many_names_are_counted_once(spark):
    n = 40_000
    cluster = np.array([f"c{k % 1000}" for k in range(n)], object)
    start = time.perf_counter()
    w = B.book_weights(np.arange(n, dtype=float), np.ones(n), cluster, np.zeros(n), 0.3, 0.0)
    assert time.perf_counter() - start < 2
    assert w.sum() == pytest.approx(0, abs=1e-9) and np.abs(w).sum() == pytest.approx(2) and w[-1] == pytest.approx(1 / 12_000)


def test_books_send_no_text_and_follow_one_another(spark):
    p = spark.createDataFrame([(t, f"n{k}", 100.0 + ((k * 7 + t * 3) % 11), 0.0, float((k * 5 + t) % 13)) for t in range(4) for k in range(8) if (t, k) != (2, 7)], "t long, symbol string, close double, funding double, score double")
    b = B.factor_books(p, "score", [B.Run("x", hold=1)])
    assert "cluster" not in plan(b).replace("cluster_by", "")
    rows = b.collect()
    held = {}
    for r in rows:
        held.setdefault(r.t, {})[r.symbol] = r.weight
    for r in rows:
        assert r.traded == pytest.approx(abs(r.weight - held.get(r.t - 1, {}).get(r.symbol, 0.0))) and r.charged == pytest.approx(r.traded * 10)
    assert {round(sum(w for w in x.values() if w > 0), 9) for x in held.values()} == {1.0}


def test_fees_of_legs_across_buckets(spark):
    fills = spark.createDataFrame([(1, 0, 5, 1.0), (None, 0, 3, 10.0), (None, 0, 9, 20.0), (None, 0, 30, None), (None, 1, 1, 7.0), (None, None, 50, 9.0)], "leg long, inst int, ts long, fee double")
    legs = spark.createDataFrame([(1, 0, 5), (2, 0, 10), (3, 0, 31), (4, 1, 0), (5, None, 0)], "leg long, inst int, created long")
    for bucket in (1, 4, 1000):
        got = {r.leg: (r.fees, r.fills) for r in R.position_fees(fills, legs, 1, bucket_ms=bucket).collect()}
        assert got == {1: (21.0, 2), 2: (20.0, 1), 3: (0.0, 0), 4: (7.0, 1), 5: (0.0, 0)}


def test_resamples_are_never_broadcast(spark):
    d = spark.createDataFrame([(k % 50, float(k), float(k % 7)) for k in range(500)], "g int, score double, v double")
    p = plan(R.top_decile_bootstrap(d, "g", "score", "v", 20, 7))
    assert "SortMergeJoin [_i" in p and "BroadcastHashJoin [_i" not in p


def test_controls_are_dealt_without_a_pivot(spark):
    assert "pivotfirst" not in plan(book_plans.shuffled_control(spark, SF))


@pytest.mark.parametrize(("block", "span"), [(2048, 512), (5, 7), (64, 7), (5, 512)])
def test_pairs_over_blocks_and_spans(spark, block, span):
    """Names that come and go, one that stands still, copies of one another: as NumPy has them, without a shuffle of pairs."""
    rng = np.random.default_rng(3)
    x = {f"n{k:02d}": {t: float(v) for t, v in zip(range(-9, 21), rng.normal(size=30), strict=True) if (t * 7 + k) % 4 and not (k > 20 and t < 9)} for k in range(24)}
    x["n05"], x["n07"] = dict.fromkeys(x["n05"], 2.0), {t: 3 * v for t, v in x["n01"].items()}
    df = spark.createDataFrame([(k, t, v) for k, s in x.items() for t, v in s.items()], "k string, t long, v double")
    want = {}
    for a in x:
        for b in x:
            if a < b and (both := sorted(x[a].keys() & x[b].keys())):
                u, v = ([s[t] for t in both] for s in (x[a], x[b]))
                want[a, b] = (len(both), None if len(set(u)) == 1 or len(set(v)) == 1 else float(np.corrcoef(u, v)[0, 1]))
    p = joins.pair_correlations(df, "k", "t", "v", block=block, span=span)
    got = {(r.a, r.b): (r.n, r["corr"]) for r in p.collect()}
    assert got.keys() == want.keys() and not any(line.lstrip(" +-:").startswith("HashAggregate(keys=[a") for line in plan(p).splitlines())
    for k, (n, c) in want.items():
        assert got[k][0] == n and (got[k][1] is None if c is None else got[k][1] == pytest.approx(c, abs=1e-9))
    few = {(r.a, r.b) for r in joins.pair_correlations(df, "k", "t", "v", block=block, span=span, least=0.2, rows=12).collect()}
    assert few == {k for k, (n, c) in want.items() if c is not None and c >= 0.2 and n >= 12}


@pytest.mark.parametrize("block", [2048, 5])
def test_best_partners_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 12))
    rows = [(k, t, 2.0 if k == 17 else float(base[k % 6, t] + (k >= 12) * (k % 3) * t)) for k in range(18) for t in range(12)] + [(90, 100, 1.0), (91, 100, 2.0), (92, 100, 3.0)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    pairs = joins.pair_correlations(df, "k", "t", "v").withColumn("corr", F.round("corr", 6))
    want = {(r.k, r.partner, r["corr"]) for r in T.best_partner(pairs, "k").collect()}
    got = joins.best_partners(df, "k", "t", "v", block=block)
    assert {(r.k, r.partner, r["corr"]) for r in got.collect()} == want and len(want) == 21


def test_links_become_forests_before_one_task_takes_them(spark):
    pairs = spark.range(40).join(spark.range(40).withColumnRenamed("id", "b")).where("id < b and id % 4 = b % 4").select(F.col("id").alias("a"), "b", F.lit(0.9).alias("corr")).repartition(3)
    c = sequential.clusters(pairs, spark.range(41).withColumnRenamed("id", "k"), "k", 0.5)
    assert plan(c).count("MapInPandas") == 2
    assert {(r.k, r.cluster) for r in c.collect()} == {(k, 40 if k == 40 else k % 4) for k in range(41)}

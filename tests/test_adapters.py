"""Plugged-in venues and models, contracts, array files and run logs, supervised streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import adapters as A
from tidemark.streaming import folds, supervision

DAY = A.DAY_MS


def venue():
    class Toy:  # in here, so that it is pickled by value
        name = "toy"

        def universe(self):
            return [("AUSDT", "A", 5.0), ("BUSDT", "B", 9.0)]

        def candles(self, symbol):
            return [(d * 86_400_000, 1.0, 2.0, 0.5, 1.5, 10.0, 3) for d in range(2 if symbol == "AUSDT" else 1)]

        def funding(self, symbol):
            return {0: 1.0, 8 * 3_600_000: 2.0} if symbol == "AUSDT" else {}

    return Toy()


def test_venue_as_a_source(spark):
    df = A.read_venue(spark, venue())
    assert df.rdd.getNumPartitions() == 2
    got = sorted((r.symbol, r.day_ms, r.funding, r.periods) for r in df.collect())
    assert got == [("AUSDT", 0, 3.0, 2), ("AUSDT", DAY, None, 0), ("BUSDT", 0, None, 0)]
    assert [x["symbol"] for x in json.loads(A.manifest(venue()))] == ["BUSDT", "AUSDT"]


def slope():
    class Slope:
        name = "slope"

        def fit(self, x, y):
            self.w = float((x[:, 0] * y).sum() / (x[:, 0] ** 2).sum())

        def predict(self, x):
            return self.w * x[:, 0]

    return Slope()


def test_models_by_name(spark):
    rows = [(k, t, "train" if t < 5 else "test", float(t), (2.0 if k == "a" else -1.0) * t) for k in "ab" for t in range(8)] + [("c", 1, "test", 1.0, 1.0), ("a", 9, "test", None, 1.0)]
    d = spark.createDataFrame(rows, "k string, t long, part string, x double, y double")
    assert isinstance(slope(), A.Model)
    kind = type(slope())
    s = A.scored_by_name(d, lambda: kind(), "k", "t", ["x"], "y")
    assert {(r.k, r.t): r.prediction for r in s.collect()} == {(k, t): pytest.approx(w * t) for k, w in (("a", 2.0), ("b", -1.0)) for t in (5, 6, 7)}
    assert {r.k: (r.rows, r.ic) for r in A.skill(s, "k", "y").collect()} == {"a": (3, pytest.approx(1)), "b": (3, pytest.approx(1))}


def test_contracts(spark):
    p = spark.createDataFrame([("a", True, ["thin"], []), ("b", False, [], ["slow"])], "inst_id string, ok boolean, reasons array<string>, warnings array<string>")
    assert {r.inst_id: r.ok for r in A.verdicts(p).collect()} == {"a": False, "b": True}
    assert A.breaches(p, A.OUTCOME) == ["dry_run: missing, not boolean", "problems: missing, not array<string>"]
    with pytest.raises(ValueError, match="warnings"):
        A.verdicts(p.drop("warnings"))


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "AUSDT.15m.npz", ts=np.arange(3), close=np.array([1.0, 2.0, 3.0]), more=np.ones(1))
    got = A.read_npz(spark, str(tmp_path), {"ts": "long", "close": "double"}).collect()
    assert sorted(map(tuple, got)) == [("AUSDT", 0, 1.0), ("AUSDT", 1, 2.0), ("AUSDT", 2, 3.0)]


LOG = "t long, inst_id string, event string, kind string, net_bps double"


def test_run_logs(spark, tmp_path):
    rows = [{"t": 0, "inst_id": "A", "event": "start"}, {"t": 1, "event": "intent", "kind": "post"}, {"t": 2, "event": "paper_fill_closed", "net_bps": 1.0}, {"t": 3_600_000, "event": "paper_fill_closed", "net_bps": 3.0}]
    (tmp_path / "run.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\nnot json\n{"t": 3')
    (r,) = A.run_log_summary(A.read_run_logs(spark, str(tmp_path), LOG)).collect()
    assert (r.inst_id, r.hours, r.stopped, r.posts, r.fills, r.net_bps, r.fills_per_day) == ("A", 1.0, False, 1, 2, 2.0, 48.0)
    assert r.net_se == pytest.approx(1.0)
    seen = []
    q = supervision.each_snapshot(A.follow_run_logs(spark, str(tmp_path), LOG), lambda b, n: seen.append((n, b.count())), str(tmp_path / "_check"))
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 4)]


def test_supervised_restarts_with_growing_pauses():
    class Query:
        def __init__(self, n):
            self.n = n

        def awaitTermination(self):
            if self.n < 3:
                raise RuntimeError("torn connection")

    starts, pauses = iter(range(9)), []
    assert supervision.supervised(lambda: Query(next(starts)), sleep=pauses.append, log=lambda _: None) == 3
    assert pauses == [1.0, 2.0, 4.0]
    with pytest.raises(RuntimeError):
        supervision.supervised(lambda: Query(0), attempts=2, sleep=lambda _: None, log=lambda _: None)
    ticking = iter(range(0, 9000, 400))
    again, pauses = iter(range(9)), []
    supervision.supervised(lambda: Query(next(again)), sleep=pauses.append, clock=lambda: next(ticking), log=lambda _: None)
    assert pauses == [1.0, 1.0, 1.0]


def test_late_rows_are_counted(spark, tmp_path):
    schema = "inst long, ts long, seq long, price double, size double"
    for k, stamps in enumerate(((0, 10_000_000), (20_000_000,), (5, 6, 30_000_000))):
        spark.createDataFrame([(0, t, t, 1.0, 1.0) for t in stamps], schema).withColumn("time", F.timestamp_millis("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
            q = folds.stream_bars(src, "inst").writeStream.format("memory").queryName("late").outputMode("append").start()
        q.processAllAvailable()
    late, still = supervision.late_rows(q), supervision.stalled(q, 1)
    q.stop()
    assert late == 2 and supervision.stalled(q, 1) and isinstance(still, bool)

"""Range fades: slip, penetration, liquidation, gates, holes, chains, segments, shuffled bars."""

import math

import pytest

from tidemark.operators import fades as E

BAR = "s string, ts long, open double, high double, low double, close double"
FLAT = [("s", k, 100.0, 101.0, 99.0, 100.0) for k in range(4)]


def trades(spark, rows, **more):
    return E.fade_trades(spark.createDataFrame([*FLAT, *rows], BAR), "s", [E.Fade("r", 4, 3, **more.pop("run", {}))], **more).collect()


def test_slip_and_penetration(spark):
    fall = [("s", 4, 100.0, 100.0, 99.15, 99.2), ("s", 5, 99.2, 99.3, 98.0, 98.5)]
    (t,) = trades(spark, fall, costs=E.Costs(1.0, 5.0, slip=10.0))
    assert (t.reason, t.side, t.fees_bps) == ("stop", 1, 6.0) and t.exit == pytest.approx(98.8 * 0.999)
    # The low is 5 bps beyond the entry at 99.2, which is not the 6 that count as filled.
    assert [x.entry_ts for x in trades(spark, fall[:1], costs=E.Costs(through=6.0))] == []
    assert len(trades(spark, fall[:1], costs=E.Costs(through=6.0), optimistic=True)) == 1


def test_liquidation(spark):
    gap = [("s", 4, 100.0, 100.0, 99.15, 99.2), ("s", 5, 60.0, 61.0, 59.0, 60.0)]
    (t,) = trades(spark, gap, leverage=5.0)
    assert t.reason == "liquidated" and t.net_bps == pytest.approx(-2000 - 2) and t.exit == pytest.approx(99.2 * 0.8 / 0.995)
    assert trades(spark, gap)[0].reason == "gap_stop"
    assert trades(spark, gap, leverage=5.0, run={"stop": 20.0}) == []  # the stop lies beyond the liquidation


def test_both_sides_in_one_bar_and_holes(spark):
    assert trades(spark, [("s", 4, 100.0, 101.0, 99.0, 100.0)]) == []
    one = [("s", 4, 100.0, 100.2, 99.1, 99.5)]
    assert [(t.reason, t.exit_ts) for t in trades(spark, one, step=1)] == [("open", 4)]
    late = [("s", 5, *one[0][2:])]
    assert trades(spark, late, step=1) == [] and len(trades(spark, late)) == 1


def test_narrow_or_trending_ranges(spark):
    one = [("s", 4, 100.0, 100.2, 99.1, 99.5)]
    assert trades(spark, one, run={"least_width_bps": 300.0}) == [] and len(trades(spark, one, run={"least_width_bps": 199.0, "most_trend": 0.1})) == 1
    assert E.fade_trades(spark.createDataFrame([], BAR), "s", [E.Fade("r", 4, 3)]).count() == 0


def test_gate_holds_entries_not_exits(spark):
    rows = [*FLAT, ("s", 4, 100.0, 100.2, 99.1, 99.5), ("s", 5, 99.6, 100.1, 99.5, 100.0)]
    d = spark.createDataFrame([(*r, r[1] == 4) for r in rows], BAR + ", go boolean")
    assert [(t.entry_ts, t.exit_ts) for t in E.fade_trades(d, "s", [E.Fade("r", 4, 3)], allow="go").collect()] == [(4, 5)]
    assert E.fade_trades(d.withColumn("go", ~d.go), "s", [E.Fade("r", 4, 3)], allow="go").where("entry_ts = 4").count() == 0


def test_chain(spark):
    e = [(0, 3), (2, 4), (3, 3), (4, 9), (9, 10), (10, 10), (40, 41)]
    d = spark.createDataFrame([("a", *x) for x in e] + [("b", 2, 4)], "k string, i long, x long")
    assert sorted((r.k, r.i) for r in E.chained(d, ["k"], "i", "x", 6).collect()) == [("a", 0), ("a", 4), ("a", 10), ("a", 40), ("b", 2)]


def test_segments(spark):
    d = spark.createDataFrame([(1, 4), (4, 6), (6, 8), (8, 9)], "entry_ts long, exit_ts long")
    got = sorted((r.entry_ts, r.segment) for r in E.segments(d, 5, 8).collect())
    assert got == [(1, "before"), (6, "after"), (8, "after"), (8, "recent")]


def test_shuffled_bars_keep_each_days_moves(spark):
    day = 86_400_000
    rows = [("s", 1 + k * day // 4, p, p * 1.1, p * 0.9, p * m) for k, (p, m) in enumerate([(100.0, 1.01), (101.0, 1.02), (103.0, 0.98), (101.0, 1.0), (101.0, 1.05), (106.0, 0.97)])]
    d = spark.createDataFrame(rows, BAR)
    was, now = (sorted(tuple(r) for r in x.select("ts", "open", "high", "low", "close").collect()) for x in (d, E.shuffled_bars(d, "s", 3)))
    assert [r[0] for r in was] == [r[0] for r in now]
    steps = lambda rows: sorted(round(math.log(r[4] / p), 9) for r, p in zip(rows[:4], [rows[0][1], *[r[4] for r in rows[:3]]], strict=True))
    assert now[3][4] == pytest.approx(was[3][4]) and now[5][4] == pytest.approx(was[5][4])
    assert sum(steps(was)) == pytest.approx(sum(steps(now)))


def test_intervals_of_days(spark):
    day = 86_400_000
    rows = lambda m: [("r", k * day + j, m(k)) for k in range(20) for j in range(1 + k % 2)]
    a = spark.createDataFrame([*rows(lambda k: float(k % 5)), ("one", 0, 7.0)], "run string, entry_ts long, net_bps double")
    got = {r.run: r for r in E.mean_interval(a, ["run"], 200, 3).collect()}
    assert (got["one"].mean, got["one"].low) == (7.0, None)
    mean = sum(x[2] for x in rows(lambda k: float(k % 5))) / 30
    assert got["r"].mean == pytest.approx(mean) and got["r"].low < mean < got["r"].high and got["r"].high - got["r"].low < 2.5
    # Drawing the same days in both leaves a constant gap as it is.
    b = spark.createDataFrame(rows(lambda k: float(k % 5) - 2.0), "run string, entry_ts long, net_bps double")
    (d,) = E.difference_interval(a, b, ["run"], 50, 3).collect()
    assert (d.difference, d.low, d.high) == (pytest.approx(2.0), pytest.approx(2.0), pytest.approx(2.0))

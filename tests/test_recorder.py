"""The recorder on a few updates worked out by hand."""

import math
import re

import pytest

from tidemark.operators import recorder as C
from tidemark.operators import windows as W
from tidemark.plans import recorder

TOUCH = "k string, ts long, seq long, bid double, bid_sz double, ask double, ask_sz double"
TRADE = "k string, ts long, seq long, price double, size double, is_buy boolean"


def test_rows_and_labels(spark):
    t = spark.createDataFrame([
        ("a", 0, 0, 99.0, 1.0, 101.0, 1.0), ("a", 500, 1, 99.0, 4.0, 101.0, 1.0), ("a", 500, 2, 99.5, 2.0, 101.5, 1.0),
        ("a", 700, 3, 102.0, 1.0, 101.0, 1.0), ("a", 1600, 4, 100.0, 1.0, 102.0, 3.0), ("a", 4000, 5, 101.0, 1.0, 103.0, 1.0),
    ], TOUCH)
    x = spark.createDataFrame([("a", 400, 0, 100.0, 2.0, True), ("a", 1500, 1, 100.0, 1.0, False), ("a", 1500, 2, 0.0, 9.0, True)], TRADE)
    rows = C.feature_rows(t, x, "k")
    got = {r.ts: r for r in rows.collect()}
    assert sorted(got) == [0, 500, 1600, 4000]  # the crossed book at 700 is no state
    assert got[500].mid == 100.5 and got[500].ofi_1s == 3.0 + (2.0 + 1.0) and got[500].obi_1 == pytest.approx(1 / 3)
    assert got[0].tape_age_s is None and got[500].tfi_1s == 1.0
    assert got[1600].tfi_1s == -1.0 and got[1600].tfi_5s == pytest.approx(1 / 3) and got[1600].trade_count_1s == 1 and got[1600].tape_age_s == 0.1
    assert got[500].ret_1s == 0.0 and got[1600].ret_1s == pytest.approx(math.log(101 / 100.5) * 1e4)
    assert got[500].rv_10s == 0.0 and got[1600].rv_10s == pytest.approx(math.sqrt((math.log(100.5 / 100) ** 2 + math.log(101 / 100.5) ** 2) / 1.6))
    assert got[4000].vol_regime == "unknown" and got[4000].history_seconds == 4.0
    out = C.recorded(rows, C.book_states(t, "k"), "k", 600, {"1s": 1000, "2s": 2000}, 60.0).collect()
    # 500 is too near to 0; 4000 has no future.
    assert sorted((r.ts, r.label_1s, r.label_2s, r.fwd_ret_bps_2s) for r in out) == [(0, 1, 1, 200.0), (1600, 1, 1, 99.0099)]


def test_nothing_in_nothing_out(spark):
    rows = C.feature_rows(spark.createDataFrame([], TOUCH), spark.createDataFrame([], TRADE), "k")
    assert rows.count() == 0


@pytest.mark.parametrize("ms", [1, 7, 40])
def test_rolled_windows_against_plain_sums(spark, ms):
    """Ties, a missing value, an infinite one and every bucket's edge; without a range frame, whose every row is gone over again."""
    rows = [("a", (k * k) % 97, None if k == 5 else float("inf") if k == 9 else k / 3) for k in range(60)] + [(None, 3, 1.0), (None, 4, 2.0)]
    df = spark.createDataFrame(rows, "k string, ts long, x double")
    out = W.rolled(df, "k", {"s": ("x", ms)}, {"n": ms}, {"a": ("ts", ms)})
    assert "RangeFrame" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        inside = [(t, x) for k, t, x in rows if k == r.k and r.ts - ms <= t <= r.ts]
        assert r.n == len(inside) and r.a == min(t for t, _ in inside) and r.s == pytest.approx(sum(x or 0.0 for _, x in inside))


def test_no_range_frame_in_the_recorder(spark):
    """A range frame costs rows times rows of a window; `history_seconds` looks at all rows so far, which is one pass."""
    p = recorder.recorded_rows(spark, "/root/testdata/sf0.001"), recorder.feature_rows(spark, "/root/testdata/sf0.001")
    for df in p:
        assert not re.search(r"RangeFrame, -\d", df._jdf.queryExecution().executedPlan().toString())


def test_returns_half_way_round_up(spark):
    s = spark.createDataFrame([("a", 0, 1, 64.0), ("a", 1, 2, 13.375), ("a", 2, 3, 13.375)], "k string, ts long, seq long, mid double")
    r = C.recorded(s.select("k", "ts", "mid"), s, "k", 1, {"x": 1}, 500.0).orderBy("ts").first()
    assert r.fwd_ret_bps_x == -7910.1562

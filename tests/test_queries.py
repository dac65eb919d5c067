"""Every query with SQL against DuckDB on the smallest tables, and operators on fixtures worked out by hand."""

import glob
import gzip
import json
import math
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, sequential
from tidemark.operators import statistics as S
from tidemark.operators import windows as W
from tidemark.plans import books, fades, recorder, registry, research, studies, venues  # noqa: F401 - these register their queries
from tidemark.sources import archive

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_asof_ties_and_missing(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 1, 3)], "k string, ts long, id int")
    right = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 5, 2, 2.0), ("a", 11, 3, 3.0)], "k string, ts long, seq int, v double")
    back = {r.id: r.r_v for r in joins.asof_backward(left, right, "k", ["v"]).collect()}
    assert back == {1: 2.0, 2: 2.0, 3: None}
    ahead = {r.id: r.r_v for r in joins.asof_forward(left, right, "k", ["v"], tolerance_ms=0).collect()}
    assert ahead == {1: 1.0, 2: None, 3: None}


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_asof_across_buckets(spark, bucket):
    """Every bucket length finds what a plain search finds, null keys and empty stretches included."""
    left = [(k, t, i) for i, (k, t) in enumerate([("a", 0), ("a", 5), ("a", 6), ("a", 40), ("b", 3), (None, 9), ("a", 99)])]
    right = [("a", 5, 1), ("a", 5, 2), ("a", 38, 3), ("b", 4, 4), (None, 2, 5)]
    ldf, rdf = spark.createDataFrame(left, "k string, ts long, id int"), spark.createDataFrame(right, "k string, ts long, seq int").withColumn("v", F.col("seq"))
    back = {r.id: r.r_v for r in joins.asof_backward(ldf, rdf, "k", ["v"], bucket_ms=bucket).collect()}
    ahead = {r.id: r.r_v for r in joins.asof_forward(ldf, rdf, "k", ["v"], bucket_ms=bucket).collect()}
    near = lambda k, ok, best: next((q for _, q in sorted(((t, q) for r, t, q in right if r == k and ok(t)), reverse=best)), None)
    assert back == {i: near(k, lambda x, t=t: x <= t, True) for k, t, i in left}
    assert ahead == {i: near(k, lambda x, t=t: x >= t, False) for k, t, i in left}


def test_non_overlapping_is_greedy(spark):
    e = spark.createDataFrame([("a", t) for t in (0, 3, 5, 6, 11, 12)], "k string, ts long")
    assert sorted(r.ts for r in sequential.non_overlapping(e, "k", 5).collect()) == [0, 6, 12]
    assert sorted(r.ts for r in sequential.non_overlapping(e, "k", 5, strict=False).collect()) == [0, 5, 11]


def test_order_book_gap_and_duplicate(spark):
    level = "array<struct<price:double,size:double>>"
    rows = [("i", 1, "snapshot", 10, 0, [(100.0, 1.0)], [(101.0, 2.0)]), ("i", 2, "update", 11, 10, [(100.5, 3.0)], []), ("i", 3, "update", 11, 10, [(99.0, 9.0)], []), ("i", 4, "update", 14, 13, [], []), ("i", 5, "update", 15, 14, [], []), ("i", 6, "snapshot", 20, 0, [(99.0, 1.0)], [(98.0, 1.0)])]
    m = spark.createDataFrame(rows, f"k string, n long, action string, seq long, prev_seq long, bids {level}, asks {level}")
    got = {r.n: (r.status, r.bid) for r in sequential.order_books(m, "k").collect()}
    assert got == {1: ("ok", 100.0), 2: ("ok", 100.5), 3: ("skipped", 100.5), 4: ("gap", 100.5), 5: ("stale", 100.5), 6: ("crossed", 99.0)}


def test_range_fade_by_hand(spark):
    flat = [("s", k, 100.0, 101.0, 99.0, 100.0) for k in range(4)]
    bars = spark.createDataFrame([*flat, ("s", 4, 100.0, 100.2, 99.1, 99.5), ("s", 5, 99.6, 100.1, 99.5, 100.0)], "s string, ts long, open double, high double, low double, close double")
    (t,) = sequential.range_fade(bars, "s", 4, 3).collect()
    assert (t.entry_ts, t.exit_ts, t.side, t.reason) == (4, 5, 1, "target")
    assert t.entry == pytest.approx(99.2) and t.exit == pytest.approx(100.0)


def test_windows_exclude_the_current_row(spark):
    b = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate((5, 1, 2, 9))], "s string, ts long, x double")
    hi, lo = W.trailing_extremes(W.ordered("s"), "x", "x", 2)
    assert [(r.hi, r.lo) for r in b.select("ts", hi.alias("hi"), lo.alias("lo")).orderBy("ts").collect()] == [(None, None), (None, None), (5.0, 1.0), (2.0, 1.0)]


def test_raw_archive_keeps_what_can_be_read(spark, tmp_path):
    line = lambda n: (json.dumps({"t": n, "n": n, "m": {"x": n}}) + "\n").encode()
    torn = gzip.compress(line(3) + line(4))
    (tmp_path / "books-00.jsonl.gz").write_bytes(gzip.compress(line(1) + b"junk\n") + gzip.compress(line(2)) + torn[:-12])
    rows = archive.read_raw_archive(spark, str(tmp_path)).collect()
    assert {1, 2} <= {r.t for r in rows if r.t is not None}
    assert {"line", "tail"} <= {r.damage for r in rows if r.damage}


def test_klines_with_header_and_microseconds(spark, tmp_path):
    (tmp_path / "K-1m.csv").write_text("open_time,open,high,low,close,volume,close_time,a,b,c,d\n1700000000000000,1,2,1,2,5,1700000059999000,1,1,1,1\n1700000000000,1,2,1,2,5,1700000059999,1,1,1,1\nbad,row\n")
    rows = archive.read_klines(spark, str(tmp_path)).collect()
    assert {r.close_time for r in rows} == {1700000059999}


def test_zip_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "1,2\n3,4\n")
    assert sorted(r.cells for r in archive.read_zip_csv(spark, str(tmp_path)).collect()) == [["1", "2"], ["3", "4"]]


def test_equity_ends_at_a_total_loss(spark):
    r = spark.createDataFrame([("a", 1, 1000.0), ("a", 2, -1000.0), ("a", 3, None), ("b", 1, 100.0), ("b", 2, -20000.0), ("b", 3, 500.0)], "k string, t long, bps double")
    got = {x.k: x for x in S.equity_path(r, "k", "t", "bps").collect()}
    assert got["a"].n == 2 and math.isclose(got["a"].equity, 1.1 * 0.9) and math.isclose(got["a"].max_drawdown, 0.1)
    assert got["b"].equity == 0 and got["b"].max_drawdown == 1


def test_carry_outcomes_by_hand(spark):
    r = spark.createDataFrame([("a", t, float(t)) for t in (0, 1, 2, 3)] + [("b", 0, 1.0)], "k string, t long, bps double")
    got = S.carry_outcomes(r, "k", "t", "bps", 2, 4.0).collect()
    assert [tuple(x) for x in got] == [("a", 2, 0.0, -1.0, -1.0, 1.0, 0.5)]

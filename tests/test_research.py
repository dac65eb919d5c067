"""Archives with damage, sinks, streams, books and blocked plans on fixtures."""

import gzip
import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions import sql_functions
from tidemark.operators import books as B
from tidemark.operators import folds as batch
from tidemark.operators import joins, sequential
from tidemark.operators import research as R
from tidemark.sources import archive, feeds, sinks
from tidemark.sources import views as V
from tidemark.streaming import folds

SF = "/root/testdata/sf0.001"


def member(lines, mtime=0):
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=mtime) as f:
        f.write(b"".join(lines))
    return out.getvalue()


def records(a, b):
    return [(json.dumps({"t": k, "n": k, "m": {"x": random.Random(k).random()}}) + "\n").encode() for k in range(a, b)]


def test_torn_members_give_their_lines_and_no_others():
    one, two, three = records(0, 1000), records(1000, 1200), records(1200, 1300)
    known = {x.strip() for x in one + two + three}
    whole = member(one)
    for mtime in range(0, 400, 7):
        for cut in (len(whole) // 2, len(whole) - 9, len(whole) - 1):
            data = whole[:cut] + member(two, mtime) + member(three)
            lines, damage = archive.gzip_members(data)
            assert [k for k, *_ in damage] == ["torn"] and damage[0][1:] == (0, cut)
            assert {x.strip() for x in two + three} <= set(lines)
            assert len([x for x in lines if x not in known]) <= 1  # the torn line
            assert len(lines) >= (450 if cut < len(whole) - 9 else 999) + 300


def test_damage_is_named_and_passed():
    a, b = member(records(0, 500)), member(records(500, 600))
    assert archive.gzip_members(a + b) == ([x.strip() for x in records(0, 600)], [])
    lines, damage = archive.gzip_members(a + b[:-5])
    assert len(lines) >= 599 and [k for k, *_ in damage] == ["tail"]
    bad = bytearray(a)
    bad[-6] ^= 255  # the check sum
    lines, damage = archive.gzip_members(bytes(bad) + b)
    assert len(lines) == 600 and [k for k, *_ in damage] == ["corrupt"]
    bad = bytearray(a)
    bad[len(a) // 2] ^= 255
    lines, damage = archive.gzip_members(bytes(bad) + b)
    assert [k for k, *_ in damage] == ["corrupt"] and [x.strip() for x in records(500, 600)] == lines[-100:]
    assert archive.gzip_members(a + bytes(50) + b)[1] == []
    lines, damage = archive.gzip_members(a + b"not gzip" + b)
    assert len(lines) == 600 and damage == [("junk", len(a), len(a) + 8)]
    assert archive.gzip_members(b"") == ([], [])


def test_channel_files_in_order(spark, tmp_path):
    for name, a, b in (("books-09.jsonl.gz", 0, 3), ("books-09.r001.jsonl.gz", 3, 5), ("books-10.jsonl.gz", 5, 6), ("trades-09.jsonl.gz", 9, 10)):
        (tmp_path / name).write_bytes(member(records(a, b)))
    rows = archive.read_channel(spark, str(tmp_path), "books").orderBy("hour", "restart", "n").collect()
    assert [(r.hour, r.restart, r.n) for r in rows] == [(9, 0, 0), (9, 0, 1), (9, 0, 2), (9, 1, 3), (9, 1, 4), (10, 0, 5)]
    day = spark.createDataFrame([(1704067199999,), (1704067200000,), (1704153599999,), (1704153600000,)], "t long")
    assert [r.t for r in archive.on_date(day, "2024-01-01").orderBy("t").collect()] == [1704067200000, 1704153599999]


def test_klines_of_several_symbols(spark, tmp_path):
    row = lambda o, c, close: f"{o},1,2,1,{close},5,{c},1,1,1,1\n"
    (tmp_path / "AAA-1m-2024-01.csv").write_text(row(0, 59999, 5) + row(60000, 119999, 6))
    (tmp_path / "AAA-1m-2024-01-01.csv").write_text(row(60000, 119999, 7))
    (tmp_path / "BBB-1m-2024-01.csv").write_text(row(0, 59999, 8))
    got = sorted((r.symbol, r.close_time, r.close) for r in archive.read_klines(spark, str(tmp_path)).collect())
    assert got == [("AAA", 59999, 5.0), ("AAA", 119999, 7.0), ("BBB", 59999, 8.0)]


def test_zip_csv_by_header_or_place(spark, tmp_path):
    for name, text in (("a", "b,a,c\n1,2,3\n4\n"), ("b", '5,"6,6",7\n8,9\n')):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", text)
    got = sorted((r.a, r.b) for r in archive.read_zip_csv(spark, str(tmp_path), ("a", "b")).collect())
    assert got == [("2", "1"), ("5", "6,6"), ("8", "9")]


def test_tops_are_snapshots_of_one_level(spark, tmp_path):
    (tmp_path / "t.csv").write_text("update_id,best_bid_price,best_bid_qty,best_ask_price,best_ask_qty,transaction_time\n1,100,2,101,3,1700000000000\n2,,2,101,3,1700000000001\n")
    (r,) = feeds.read_tops(spark, str(tmp_path)).collect()
    assert (r.ts, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) == (1700000000000, [(100.0, 2.0)], [(101.0, 3.0)])


def test_sinks_refuse_a_table_that_is_there(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 1.0, 5.0, "train"), ("a", 1, 2.0, 6.0, "train"), ("b", 1, 3.0, 7.0, "test")], "symbol string, ts long, f double, y double, part string")
    sinks.write_series(df, str(tmp_path / "s"), "symbol", "ts")
    sinks.write_dataset(df, str(tmp_path / "d"), ["f"], ["y"], "symbol", "ts")
    assert sorted(map(tuple, sinks.write_bar_features(df, str(tmp_path / "f"), ["f"], "symbol", "ts").collect())) == [("a", 2, 1, 2), ("b", 1, 1, 1)]
    assert spark.read.parquet(str(tmp_path / "f")).columns == ["symbol", "ts", "f"]
    assert spark.read.parquet(str(tmp_path / "d")).where("part = 'test'").count() == 1
    with pytest.raises(AnalysisException):
        sinks.write_series(df, str(tmp_path / "s"), "symbol", "ts")


def stream_of(spark, df, path, parts=1):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_stream_bars_are_the_batch_folds(spark, tmp_path):
    edge = spark.createDataFrame([(99, k * 1_800_000, k, 5.0 + k, 1.0) for k in range(1, 9)], "inst long, ts long, seq long, price double, size double")
    t = V.ticks(spark, SF).select("inst", "ts", "seq", "price", "size").unionByName(edge).withColumn("time", F.timestamp_millis("ts"))
    got = run(folds.stream_bars(stream_of(spark, t, str(tmp_path / "in")), "inst"), "bars_all", "complete")
    want = batch.fold_ticks(t.withColumn("is_buy", F.lit(True)), "inst", 3_600_000)
    cols = ["open", "high", "low", "close", "n"]
    a = {(r.inst, int(r.end.timestamp() * 1000)): [r[c] for c in cols] for r in got.collect()}
    b = {(r.inst, r.ts): [r[c] for c in cols] for r in want.collect()}
    assert a == b


def test_stream_windows_and_duplicates(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 2.0), ("a", 100, 4.0), ("a", 100, 4.0), ("b", 5, 8.0)], "k string, s long, size double").withColumn("time", F.timestamp_seconds("s"))
    src = lambda n: stream_of(spark, rows, str(tmp_path / n))
    got = run(folds.sessions(src("x"), "k", "30 seconds"), "sess", "complete").collect()
    assert sorted((r.k, int(r.start.timestamp()), int(r.end.timestamp()), r.n) for r in got) == [("a", 0, 40, 2), ("a", 100, 130, 2), ("b", 5, 35, 1)]
    got = {(r.k, int(r.end.timestamp())): r["size"] for r in run(folds.sliding_sums(src("y"), "k", "40 seconds", "20 seconds"), "slide", "complete").collect()}
    assert got[("a", 20)] == 3.0 and got[("a", 40)] == 3.0 and got[("a", 120)] == 8.0
    later = rows.withColumn("time", F.timestamp_seconds(F.col("s") + 1000))  # the epoch itself is the first watermark
    assert run(folds.deduplicated(stream_of(spark, later, str(tmp_path / "z")), ["k", "s"]), "dedup").count() == 4


def test_labels_are_the_last_price_in_the_horizon(spark, tmp_path):
    rows = spark.createDataFrame([("a", 10, 1.0), ("a", 50, 2.0)], "k string, s long, price double").withColumn("time", F.timestamp_seconds("s")).drop("s")
    ticks = spark.createDataFrame([("a", 10, 1, 9.0), ("a", 20, 2, 10.0), ("a", 30, 3, 11.0), ("a", 41, 4, 12.0), ("b", 20, 5, 1.0), ("a", 9000, 6, 0.0)], "k string, s long, seq long, price double").withColumn("time", F.timestamp_seconds("s")).drop("s")
    late = spark.createDataFrame([("a", 9000, 3.0)], "k string, s long, price double").withColumn("time", F.timestamp_seconds("s")).drop("s")
    s = folds.labelled(stream_of(spark, rows.unionByName(late), str(tmp_path / "r")), stream_of(spark, ticks, str(tmp_path / "t")), "k", "30 seconds")
    got = run(s, "labels").collect()
    assert [(r.k, int(r.time.timestamp()), r.price, r.label) for r in got] == [("a", 10, 1.0, 11.0)]


def test_a_batch_given_again_replaces_itself(spark, tmp_path):
    sink = folds.idempotent_sink(str(tmp_path / "out"))
    sink(spark.range(5), 0)
    sink(spark.range(3), 1)
    sink(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_pair_correlations_by_blocks_and_spans(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(23, 40))
    x[5] = 3.0
    has = g.random((23, 40)) < 0.7
    df = spark.createDataFrame([(f"s{k:02d}", t, float(x[k, t])) for k in range(23) for t in range(40) if has[k, t]], "s string, t long, v double")
    for block, span in ((512, 4096), (5, 7)):
        got = {(r.a, r.b): (r.n, r["corr"]) for r in joins.pair_correlations(df, "s", "t", "v", block, span).collect()}
        for i in range(23):
            for j in range(i + 1, 23):
                both = has[i] & has[j]
                n, c = got.pop((f"s{i:02d}", f"s{j:02d}"))
                assert n == both.sum()
                assert c is None if 5 in (i, j) else c == pytest.approx(np.corrcoef(x[i][both], x[j][both])[0, 1], abs=1e-9)
        assert not got


def test_many_bands_are_joined(spark, monkeypatch):
    bands = spark.createDataFrame([(0.0, 10.0, 1), (10.0, 20.0, 2), (20.0, 30.0, 3)], "lo double, hi double, rate int")
    df = spark.createDataFrame([(k, float(k)) for k in (-5, 0, 3, 10, 11, 20, 29, 30, 31)], "ts long, x double")
    want = sorted(map(tuple, joins.band_join(df, bands, "x", "lo", "hi", ["rate"]).collect()))
    monkeypatch.setattr(joins, "MOST_BANDS", 2)
    assert sorted(map(tuple, joins.band_join(df, bands, "x", "lo", "hi", ["rate"]).collect())) == want


def test_groups_need_what_is_left_after_the_common_move(spark):
    g = np.random.default_rng(2)
    market, own = g.normal(size=60) * 5, g.normal(size=(6, 60))
    own[1] = own[0] + g.normal(size=60) * 0.1
    rows = [(f"s{k}", t, float(market[t] + own[k, t])) for k in range(6) for t in range(60)] + [("few", t, float(market[t] + own[0, t])) for t in range(19)]
    got = dict(map(tuple, sequential.correlated_groups(spark.createDataFrame(rows, "s string, t long, r double"), "s", "t", "r").collect()))
    assert got == {"s0": "s0", "s1": "s0", "s2": "s2", "s3": "s3", "s4": "s4", "s5": "s5", "few": "few"}


def test_a_band_keeps_names_that_drift():
    score = np.arange(10.0)
    flat, own = np.ones(10), np.array([str(k) for k in range(10)])
    first = B.book_weights(score, flat, own, np.zeros(10), 0.2, 0.2)
    assert np.flatnonzero(first > 0).tolist() == [8, 9] and np.flatnonzero(first < 0).tolist() == [0, 1]
    moved = score.copy()
    moved[[7, 8]] = moved[[8, 7]]  # 8 drifts out of the top two, but not out of the band
    assert np.flatnonzero(B.book_weights(moved, flat, own, first, 0.2, 0.2) > 0).tolist() == [8, 9]
    assert np.flatnonzero(B.book_weights(moved, flat, own, first, 0.2, 0.0) > 0).tolist() == [7, 9]
    moved[8] = 4.5  # out of the band
    assert np.flatnonzero(B.book_weights(moved, flat, own, first, 0.2, 0.2) > 0).tolist() == [7, 9]
    risky = B.book_weights(score, np.where(np.arange(10) == 9, 4.0, 1.0), np.array(["a"] * 10), np.zeros(10), 0.2, 0.0)
    assert risky[9] == pytest.approx(0.2) and risky[8] == pytest.approx(0.8) and risky[:2].sum() == pytest.approx(-1)
    assert not B.book_weights(score[:5], flat[:5], own[:5], np.zeros(5), 0.2, 0.0).any()


def test_a_name_that_stops_leaves_its_side_whole(spark):
    rows = [(t, k, 10.0 + k + t * (k % 3), 1.0, float(k)) for t in range(4) for k in range(8) if not (k == 7 and t >= 2)]
    panel = spark.createDataFrame(rows, "t long, symbol long, close double, funding double, score double")
    got = B.factor_books(panel, "score", [B.Run("r", hold=2, share=0.25)]).where("t = 0").collect()
    assert {r.symbol: r.weight for r in got} == {6: 1.0, 0: -0.5, 1: -0.5}


def test_range_fade_against_a_plain_walk(spark):
    rnd = random.Random(5)
    rows, price = [], 100.0
    for k in range(3000):
        o = price * math.exp(rnd.gauss(0, 0.002 if rnd.random() < 0.9 else 0.02))
        c = o * math.exp(rnd.gauss(0, 0.004))
        rows.append(("s", k, o, max(o, c) * (1 + abs(rnd.gauss(0, 0.002))), min(o, c) * (1 - abs(rnd.gauss(0, 0.002))), c))
        price = c
    df = spark.createDataFrame(rows, "s string, ts long, open double, high double, low double, close double")
    for pessimistic in (True, False):
        got = [(r.entry_ts, r.exit_ts, r.side, r.reason, round(r.net_bps, 6)) for r in sequential.range_fade(df, "s", 20, 30, pessimistic=pessimistic).orderBy("entry_ts").collect()]
        assert got == plain_fade(rows, 20, 30, pessimistic)
        assert {"target", "stop", "time"} <= {x[3] for x in got} and any(x[3].startswith("gap") for x in got)


def plain_fade(rows, look, hold, pessimistic):
    """Every bar's would-be trade first, each worked out by itself; then the chain of those that don't overlap."""
    trades = {}
    for i in range(look, len(rows)):
        hi, lo = max(r[3] for r in rows[i - look : i]), min(r[4] for r in rows[i - look : i])
        w = hi - lo
        _, _, o, h, l, _ = rows[i]  # noqa: E741
        sides = [s for s, hit in ((1, o > lo + 0.1 * w and l <= lo + 0.1 * w), (-1, o < hi - 0.1 * w and h >= hi - 0.1 * w)) if hit and w > 0]
        if len(sides) != 1:
            continue
        side = sides[0]
        edge = lo if side > 0 else hi
        entry, stop, target = (edge + side * x * w for x in (0.1, -0.1, 0.5))
        beyond = lambda price, level, sign, side=side: side * sign * (price - level) >= 0
        out = None
        for k in range(i, min(i + hold, len(rows) - 1) + 1):
            _, _, o, h, l, c = rows[k]  # noqa: E741
            worst, best = (l, h) if side > 0 else (h, l)
            stopped, reached = beyond(worst, stop, -1), beyond(best, target, 1)
            if k > i and beyond(o, stop, -1):
                out = (k, o, "gap_stop")
            elif k > i and beyond(o, target, 1):
                out = (k, o, "gap_target")
            elif reached and (not pessimistic or (k > i and not stopped)):
                out = (k, target, "target")
            elif stopped:
                out = (k, stop, "stop")
            if out:
                break
        if not out:
            last = min(i + hold, len(rows) - 1)
            out = (last, rows[last][5], "time" if i + hold <= len(rows) - 1 else "open")
        fee = 4.0 if out[2] in ("target", "gap_target") else 8.0
        trades[i] = (i, out[0], side, out[2], round(side * (out[1] / entry - 1) * 1e4 - fee, 6))
    chain, free = [], 0
    for i in sorted(trades):
        if i >= free:
            chain.append(trades[i])
            free = trades[i][1] + 1
    return chain


def test_fees_of_open_positions(spark):
    legs = spark.createDataFrame([(1, "x", 100), (2, "x", 500), (3, "y", 0)], "leg long, inst string, created long")
    fills = spark.createDataFrame([(1, "x", 90, 1.0), (None, "x", 96, 2.0), (None, "x", 600, 4.0), (9, "x", 700, 8.0)], "leg long, inst string, ts long, fee double")
    assert {r.leg: (r.fees, r.fills) for r in R.position_fees(fills, legs, 5).collect()} == {1: (7.0, 3), 2: (4.0, 1), 3: (0.0, 0)}


def test_sql_functions(spark):
    sql_functions.register(spark)
    r = spark.sql("SELECT since_ms('90m', 10000000L) a, since_ms('2d', 0L) b, since_ms('1970-01-01T00:00:01Z', 5L) c, variance_ratio_class(0.5D, 0.1D) d, variance_ratio_class(1.05D, 0.1D) e, agrees_with_exchange(100.5D, 100D) f, agrees_with_exchange(102D, 100D) g, log_blend(4D, 9D, 0.5D) h").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (10000000 - 5400000, -172800000, 1000, "reverting", "scale-invariant", True, False) and r.h == pytest.approx(6)


def test_columns_that_never_change_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 1.0), (1.0, 3.0, None, None)], "a double, b double, c double, d double")
    assert R.varying(df, ["a", "b", "c", "d"]) == ["b"]


def test_gaussian_tail(spark):
    got = spark.range(1).select(*[R.gaussian_tail(F.lit(k)).alias(f"k{n}") for n, k in enumerate((0.0, 0.5, 1.0, 2.0, 4.0))]).first()
    assert list(got) == pytest.approx([math.erfc(k / math.sqrt(2)) for k in (0.0, 0.5, 1.0, 2.0, 4.0)], abs=3e-7)


def test_snapshots_append_and_the_baseline_stays(spark, tmp_path):
    one, two = (spark.createDataFrame([(k, 1.0 * k)], "ts long, equity double") for k in (1, 2))
    for x in (one, two):
        sinks.append_snapshot(x, str(tmp_path / "s"))
    assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 2]
    assert [sinks.load_or_freeze(x, str(tmp_path / "b")).first().ts for x in (one, two)] == [1, 1]

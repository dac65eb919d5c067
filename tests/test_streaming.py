"""Streams give what the batch folds give."""

from pyspark.sql import functions as F

from tidemark.sources import views as V
from tidemark.streaming import folds

SF = "/root/testdata/sf0.001"


def test_changes(spark, tmp_path):
    rows = [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 1, 5.0), ("a", 3, 9.0)]
    spark.createDataFrame(rows, "k string, ts long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = folds.stream_changes(spark.readStream.schema("k string, ts long, v double").parquet(str(tmp_path / "in")), "k", "v")
    q = s.writeStream.format("memory").queryName("changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from changes").collect()} == {("a", 1, 1.0), ("a", 3, 2.0), ("b", 1, 5.0)}


def test_bars_stream_matches_batch(spark, tmp_path):
    t = V.ticks(spark, SF).select("inst", "ts", "seq", "price", "size", F.timestamp_millis("ts").alias("time"))
    t.repartition(1).write.parquet(str(tmp_path / "in"))
    s = folds.stream_bars(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), "inst")
    q = s.writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n) as n, count(*) as bars from bars").first()
    want = t.groupBy("inst", F.window("time", "1 hour")).count().agg(F.sum("count"), F.count(F.lit(1))).first()
    assert tuple(got) == tuple(want)

"""What the engine writes: labelled features, panels, maps, data sets with their split, and reports of coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INTS = {"ts", "received_ts", "trade_count_1s", "book_age_ms"}
STRINGS, BOOLS = {"vol_regime", "inst", "symbol"}, {"is_valid"}


def write_features(df: DataFrame, path: str, labels: list[str], by: str = "inst") -> None:
    """Rows whose labels are all there, as ZSTD Parquet by instrument; a path that holds something is refused."""
    df.dropna(subset=labels).write.mode("errorifexists").option("compression", "zstd").partitionBy(by).parquet(path)


def csv_to_parquet(spark: SparkSession, source: str, path: str) -> None:
    """Feature CSV as ZSTD Parquet; types go by column name, all others are doubles. The source stays."""
    kind = lambda c: "long" if c in INTS or c.startswith("label_") else "string" if c in STRINGS else "boolean" if c in BOOLS else "double"
    raw = spark.read.option("header", True).csv(source)
    raw.select(*[F.col(c).try_cast(kind(c)).alias(c) for c in raw.columns]).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_panel(df: DataFrame, path: str, at: str = "date", key: str = "symbol") -> None:
    """CSV in the order of time and name: ranges of time are the files, so none has to hold everything."""
    df.repartitionByRange(at, key).sortWithinPartitions(at, key).write.mode("overwrite").option("header", True).csv(path)


def whole_cross_sections(df: DataFrame, at: str, cols: list[str], least: int) -> DataFrame:
    """Rows whose columns are all finite, of times that at least `least` of them share."""
    ok = df
    for c in cols:
        ok = ok.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return ok.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(at))).where(F.col("_n") >= least).drop("_n")


def write_maps(df: DataFrame, path: str, coin: str = "coin", at: str = "as_of_ms") -> None:
    """One JSON line a map, by coin and day."""
    day = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd")
    df.select(F.col(coin), day.alias("day"), F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").partitionBy(coin, "day").text(path)


def coverage(df: DataFrame, key: str, ts: str, day_ms: int = 86_400_000) -> DataFrame:
    """Per key: days with a row, days there should be between the first and the last day of all, and the share."""
    d = df.select(F.col(key), F.floor(F.col(ts) / day_ms).alias("_d")).distinct()
    ends = d.agg((F.max("_d") - F.min("_d") + 1).alias("expected"))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("days")).join(F.broadcast(ends)).withColumn("share", F.col("days") / F.col("expected"))


def write_series(df: DataFrame, path: str, key: str, at: str) -> None:
    """One folder of columnar files for each key, in time order inside; refuses a folder that already holds a table."""
    df.repartition(key).sortWithinPartitions(key, at).write.mode("errorifexists").partitionBy(key).parquet(path)


def write_dataset(df: DataFrame, path: str, features: list[str], targets: list[str], key: str, at: str, part: str = "part") -> None:
    """Features, targets and the exact split of each row, for other runtimes; refuses a folder that already holds a table."""
    df.select(key, at, part, *features, *targets).repartition(key).sortWithinPartitions(key, at).write.mode("errorifexists").partitionBy(key, part).parquet(path)


def write_bar_features(df: DataFrame, path: str, columns: list[str], key: str, at: str) -> DataFrame:
    """Writes the named columns, others ignored, and gives per key the number of rows and the first and last stamp."""
    df.select(key, at, *columns).write.mode("errorifexists").parquet(path)
    out = df.sparkSession.read.parquet(path)
    return out.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    """Adds a snapshot to its table."""
    snapshot.write.mode("append").parquet(path)


def load_or_freeze(snapshot: DataFrame, path: str) -> DataFrame:
    """The baseline at path: the first snapshot ever given stays it; later ones change nothing."""
    snapshot.write.mode("ignore").parquet(path)
    return snapshot.sparkSession.read.schema(snapshot.schema).parquet(path)

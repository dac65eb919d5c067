"""Surfaces to plug one's own parts into: venues as a data source, models, reports of strategies; and readers of run logs and per-symbol arrays."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.functions.moments import corr


class Adapter(Protocol):
    """A venue: its coins, and the daily candles (day_ms, open, high, low, close, quote_volume, trades) and funding of one symbol."""

    name: str

    def universe(self) -> Sequence[tuple[str, str, float]]: ...  # symbol, coin, 24 h volume

    def candles(self, symbol: str) -> Sequence[tuple]: ...

    def funding(self, symbol: str) -> dict[int, float]: ...


CANDLE = "symbol string, coin string, day_ms long, open double, high double, low double, close double, volume double, trades double, funding double, periods int"
DAY_MS = 86_400_000


class _Symbol(InputPartition):
    def __init__(self, symbol: str, coin: str):
        super().__init__((symbol, coin))


class _VenueReader(DataSourceReader):
    def __init__(self, adapter: Adapter):
        self.adapter = adapter

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s, c) for s, c, _ in self.adapter.universe()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        symbol, coin = partition.value
        rates: dict[int, list[float]] = {}
        for ms, rate in self.adapter.funding(symbol).items():
            rates.setdefault(ms // DAY_MS, []).append(rate)
        for day_ms, *prices in self.adapter.candles(symbol):
            paid = rates.get(day_ms // DAY_MS)
            yield (symbol, coin, int(day_ms), *map(float, prices), sum(paid) if paid else None, len(paid or ()))


def venue_source(adapter: Adapter, format_name: str) -> type[DataSource]:
    """A data source over an adapter, to be registered: one partition a symbol, read by the executors, days without funding null with 0 periods.

    The adapter is pickled to them, so it holds no open connection.
    """

    class Venue(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return CANDLE

        def reader(self, schema: StructType) -> DataSourceReader:
            return _VenueReader(adapter)

    return Venue


def read_venue(spark: SparkSession, adapter: Adapter) -> DataFrame:
    """Daily rows of all of a venue's symbols."""
    name = f"venue_{adapter.name}"
    spark.dataSource.register(venue_source(adapter, name))
    return spark.read.format(name).load()


@runtime_checkable
class Model(Protocol):
    """Anything that learns from (X, y) and scores rows; no base class."""

    name: str

    def fit(self, x: np.ndarray, y: np.ndarray) -> None: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


def scored_by_name(df: DataFrame, make: Callable[[], Model], key: str, at: str, features: list[str], target: str, part: str = "part") -> DataFrame:
    """(key, at, target, prediction) of the rows whose `part` is 'test', by a model of each key fitted on its 'train' rows.

    A key's rows are one group, held by one task; a key without rows to learn from gives none, rows with a null feature or target are left out.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[*features, target]).sort_values(at)
        train, test = pdf[pdf[part] == "train"], pdf[pdf[part] == "test"]
        out = test[[key, at, target]].copy()
        if len(train) == 0 or len(test) == 0:
            return out.iloc[:0].assign(prediction=pd.Series(dtype=float))
        model = make()
        model.fit(train[features].to_numpy(float), train[target].to_numpy(float))
        return out.assign(prediction=np.asarray(model.predict(test[features].to_numpy(float)), float))

    rows = df.select(key, at, part, target, *features)
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, `{target}` {kinds[target]}, prediction double")


def skill(scored: DataFrame, key: str, target: str) -> DataFrame:
    """Rows and correlation of prediction and target per key."""
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), corr("prediction", target).alias("ic"))


#: What a strategy's plans, outcomes and reports have in common: every reason, not the first; whether it was real; what needs a person.
PLAN = {"inst_id": "string", "ok": "boolean", "reasons": "array<string>", "warnings": "array<string>"}
OUTCOME = {"inst_id": "string", "dry_run": "boolean", "problems": "array<string>"}
REPORT = {"inst_id": "string", "alerts": "array<string>"}


def breaches(df: DataFrame, contract: dict[str, str]) -> list[str]:
    """Columns of a contract that df lacks or has with another type."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'missing')}, not {t}" for c, t in contract.items() if have.get(c) != t]


def verdicts(plans: DataFrame) -> DataFrame:
    """Plans whose `ok` follows from their reasons: a plan with a reason against it is not ok."""
    if bad := breaches(plans, PLAN):
        raise ValueError("; ".join(bad))
    return plans.withColumn("ok", F.coalesce(F.size("reasons") == 0, F.lit(True)))


def read_npz(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of per-symbol array files `<symbol>.<anything>.npz`: symbol and the named arrays, which must be of one length. One file is one unit of work."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({"symbol": file.rsplit("/", 1)[-1].split(".")[0]} | {c: z[c] for c in columns})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(rows, ", ".join(["symbol string", *[f"`{c}` {t}" for c, t in columns.items()]]))


def _logged(lines: DataFrame, schema: str) -> DataFrame:
    r = lines.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return r.where("r is not null and r._bad is null").select("file", "r.*").drop("_bad")


def read_run_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-line run logs with the file they come from; lines that aren't JSON go."""
    return _logged(spark.read.text(path), schema)


def follow_run_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same as a stream: each file that appears is read once, from its start; a log is to be rotated into the folder whole, not written there."""
    return _logged(spark.readStream.format("text").load(path), schema)


def run_log_summary(rows: DataFrame) -> DataFrame:
    """Per run log (file, t, inst_id, event, kind, net_bps): hours, whether it stopped, posts, closed fills, their mean net, its error, fills a day."""
    closed = F.when(F.col("event") == "paper_fill_closed", F.col("net_bps"))
    out = rows.groupBy("file").agg(
        F.min_by("inst_id", F.when(F.col("inst_id").isNotNull(), F.col("t"))).alias("inst_id"), ((F.max("t") - F.min("t")) / 3.6e6).alias("hours"), F.max("t").alias("last_ms"), F.coalesce(F.bool_or(F.col("event") == "stop"), F.lit(False)).alias("stopped"),
        F.count(F.when((F.col("event") == "intent") & (F.col("kind") == "post"), 1)).alias("posts"), F.count(closed).alias("fills"), F.avg(closed).alias("net_bps"), F.stddev_samp(closed).alias("_sd"),
    )
    return out.withColumn("net_se", F.when(F.col("fills") > 1, F.col("_sd") / F.sqrt("fills"))).withColumn("fills_per_day", F.col("fills") / F.greatest(F.col("hours"), F.lit(1e-9)) * 24).drop("_sd")


def manifest(adapter: Adapter) -> str:
    """An adapter's universe as JSON, largest first."""
    rows: list[Any] = sorted(adapter.universe(), key=lambda x: -x[2])
    return json.dumps([{"symbol": s, "coin": c, "volume": v} for s, c, v in rows])

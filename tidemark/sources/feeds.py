"""Vendor files as frames: order-book snapshots, trades, metrics, premiums, depth bands, panels, maps and run logs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def in_ms(stamp: Column) -> Column:
    """Epoch milliseconds of a stamp in milliseconds or, beyond 1e14, microseconds."""
    return F.when(stamp > 100_000_000_000_000, F.floor(stamp / 1000)).otherwise(stamp).cast("long")


def text_ms(stamp: str) -> Column:
    """Epoch milliseconds of `YYYY-MM-DD HH:MM:SS` in UTC, whatever the session's zone; null if malformed."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', try_to_timestamp({stamp}, 'yyyy-MM-dd HH:mm:ss')::timestamp_ntz) div 1000")


def number(name: str) -> Column:
    """A finite number, or null for anything else."""
    x = F.col(f"`{name}`").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(ts, bids, asks) of a CSV with columns bids[i].price, bids[i].amount and the same for asks, best first; a side ends at its first blank level."""
    raw = _csv(spark, path)
    depth = 1 + max(int(m[1]) for c in raw.columns if (m := re.fullmatch(r"bids\[(\d+)\]\.price", c)))

    def side(name: str) -> Column:
        levels = F.array(*[F.struct(number(f"{name}[{i}].price").alias("price"), number(f"{name}[{i}].amount").alias("size")) for i in range(depth)])
        blank = F.array_position(F.transform(levels, lambda x: x["price"].isNull() | x["size"].isNull()), True)
        return F.slice(levels, F.lit(1), F.when(blank > 0, blank - 1).otherwise(depth).cast("int"))

    return raw.select(in_ms(F.col("timestamp").try_cast("long")).alias("ts"), side("bids").alias("bids"), side("asks").alias("asks")).where("ts is not null")


def read_tops(spark: SparkSession, path: str, ts: str = "transaction_time", columns: tuple[str, ...] = ("best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty")) -> DataFrame:
    """(ts, bids, asks) of a top-of-book CSV: each row is a whole snapshot of one level a side; rows without both are dropped."""
    raw = _csv(spark, path).select(in_ms(F.col(ts).try_cast("long")).alias("ts"), *[number(c).alias(f"_{k}") for k, c in enumerate(columns)]).dropna()
    level = lambda p, q: F.array(F.struct(F.col(p).alias("price"), F.col(q).alias("size")))
    return raw.select("ts", level("_0", "_1").alias("bids"), level("_2", "_3").alias("asks"))


def implausible(bids: str = "bids", asks: str = "asks", ts: str = "ts") -> Column:
    """Everything wrong with a book row: stamp out of range, empty side, price not positive, levels out of order, bid not under ask."""
    b, a = F.col(bids), F.col(asks)
    up = lambda x: F.transform(x, lambda l: l["price"])
    ordered = (F.sort_array(up(b), False) == up(b)) & (F.sort_array(up(a)) == up(a))
    rules = {
        "stamp": (F.col(ts) > 1_000_000_000_000) & (F.col(ts) < 4_000_000_000_000), "empty": (F.size(b) > 0) & (F.size(a) > 0),
        "price": F.forall(b, lambda l: l["price"] > 0) & F.forall(a, lambda l: l["price"] > 0), "order": ordered, "crossed": F.get(b, 0)["price"] < F.get(a, 0)["price"],
    }
    return F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())


def read_trades(spark: SparkSession, path: str, maker_flag: str | None = "is_buyer_maker", side: str = "side", ts: str = "time", price: str = "price", size: str = "qty") -> DataFrame:
    """(ts, price, size, is_buy), is_buy of the aggressor: a buyer who made the market was sold to. Without a maker flag `side` names the aggressor; rows with neither are dropped."""
    raw = _csv(spark, path)
    word = F.lower(F.trim(F.col(maker_flag or side)))
    buy = F.when(word == "true", False).when(word == "false", True) if maker_flag else F.when(word == "buy", True).when(word == "sell", False)
    return raw.select(in_ms(F.col(ts).try_cast("long")).alias("ts"), number(price).alias("price"), number(size).alias("size"), buy.alias("is_buy")).dropna()


def read_metrics(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(ts, one column per entry of `columns`: new name -> name in the file) by create_time; malformed rows go, of equal stamps one stays."""
    raw = _csv(spark, path)
    return raw.select(text_ms("create_time").alias("ts"), *[number(c).alias(n) for n, c in columns.items()]).where("ts is not null").groupBy("ts").agg(*[F.max(n).alias(n) for n in columns])


def depth_bands(spark: SparkSession, path: str, bands: tuple[str, ...] = ("0.2", "1", "2", "5")) -> DataFrame:
    """(ts, neg_<band>, pos_<band>): notional within each distance on either side, from rows (timestamp, percentage, depth, notional)."""
    raw = _csv(spark, path).select(text_ms("timestamp").alias("ts"), number("percentage").alias("p"), number("notional").alias("v")).where("ts is not null")
    cells = [F.max(F.when(F.col("p") == sign * float(b), F.col("v"))).alias(f"{name}_{b.replace('.', 'p')}") for name, sign in (("neg", -1), ("pos", 1)) for b in bands]
    return raw.groupBy("ts").agg(*cells)


def read_panel(spark: SparkSession, path: str, least_minutes: int = 1430) -> DataFrame:
    """The daily panel: numbers or null, funding null on days without a settlement, complete where enough minutes traded."""
    raw = _csv(spark, path)
    text = ("date", "symbol")
    out = raw.select(F.col("date").try_cast("date").alias("date"), "symbol", *[number(c).alias(c) for c in raw.columns if c not in text])
    return out.withColumn("funding_bps", F.when(F.col("funding_periods") > 0, F.col("funding_bps"))).withColumn("complete", F.coalesce(F.col("minutes") >= least_minutes, F.lit(False))).where("date is not null")


def with_spreads(df: DataFrame, spreads: DataFrame, default_bps: float, key: str = "symbol") -> DataFrame:
    """df with spread_bps; names without one are charged the default."""
    one = spreads.groupBy(key).agg(F.max("spread_bps").alias("spread_bps"))
    return df.join(one, key, "left").fillna(default_bps, ["spread_bps"])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-line log by an explicit schema; lines that aren't JSON go."""
    lines = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return lines.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def shared_columns(frames: list[DataFrame]) -> DataFrame:
    """Union of files of different vintage over the columns they all have."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(*names) for f in frames])

"""Market-shaped views of the supplied tables: ticks, touches, bars, a factor panel, funding, tiers and positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.folds import fold_ticks

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) div 1000")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, after a step off the halves: sums of another order then round alike."""
    return F.round(x + 1e-9, digits)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst, ts, seq, price, size, is_buy, event_type) from events."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("inst"), epoch_ms("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (1 + k).alias("size"), F.col("event_type").isin("click", "purchase").alias("is_buy"), "event_type")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-of-book updates: the `view` events, ask a tenth of a percent above the bid."""
    t = ticks(spark, sf_dir).where("event_type = 'view'")
    return t.select("inst", "ts", "seq", F.col("price").alias("bid"), F.col("size").alias("bid_sz"), (F.col("price") * 1.001).alias("ask"), (F.col("size") + 2).alias("ask_sz"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("event_type <> 'view'").drop("event_type")


def bars(spark: SparkSession, sf_dir: str, bar_ms: int = HOUR_MS) -> DataFrame:
    """Bars per event type: symbol, ts (bar end), open, high, low, close, volume, taker, n."""
    return fold_ticks(ticks(spark, sf_dir).withColumnRenamed("event_type", "symbol"), "symbol", bar_ms)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel per supplier: t (month number), symbol, close, volume, funding, taker, complete."""
    m = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("t")
    return table(spark, sf_dir, "lineitem").groupBy(m, F.col("l_suppkey").alias("symbol")).agg(
        rounded(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.round(F.sum("l_extendedprice"), 4).alias("volume"),
        rounded((F.avg("l_discount") - 0.05) * 1e4).alias("funding"), rounded(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))).alias("taker"), (F.count(F.lit(1)) >= 3).alias("complete"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, bps, seq) from orders."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("symbol"), epoch_ms("o_orderdate").alias("ts"), F.round(F.col("o_totalprice") % 100 - 50, 4).alias("bps"), F.col("o_orderkey").alias("seq"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin tiers over p_size: min_size, max_size, mmr, by five bands of ten."""
    return table(spark, sf_dir, "part").select(F.floor((F.col("p_size") - 1) / 10).cast("int").alias("band")).distinct().select((F.col("band") * 10).cast("double").alias("min_size"), (F.col("band") * 10 + 10).cast("double").alias("max_size"), (0.005 * (F.col("band") + 1)).alias("mmr"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account positions from lineitem: user, coin, size (signed), entry, liq (null where there is no discount), value."""
    side = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("user"), F.col("l_returnflag").alias("coin"), (side * F.col("l_quantity")).alias("size"), price.alias("entry"), F.when(F.col("l_discount") > 0, price * (1 - side * F.col("l_discount") * 4)).alias("liq"), F.col("l_extendedprice").alias("value"))


#: The same views as common table expressions for the SQL side.
SQL = {
    "ticks": """ticks AS (SELECT user_id % 8 AS inst, epoch_us(ts) // 1000 AS ts, event_id AS seq, value AS price, 1 + (props->>'$.k')::DOUBLE AS size,
        event_type IN ('click', 'purchase') AS is_buy, event_type FROM events)""",
    "touches": "touches AS (SELECT inst, ts, seq, price AS bid, size AS bid_sz, price * 1.001 AS ask, size + 2 AS ask_sz FROM ticks WHERE event_type = 'view')",
    "trades": "trades AS (SELECT inst, ts, seq, price, size, is_buy FROM ticks WHERE event_type <> 'view')",
    "bars": """bars AS (SELECT event_type AS symbol, ((ts - 1) // 3600000 + 1) * 3600000 AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, (ts, seq)) AS close, sum(size) AS volume, sum(CASE WHEN is_buy THEN size ELSE 0 END) AS taker, count(*) AS n FROM ticks GROUP BY 1, 2)""",
    "panel": """panel AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS t, l_suppkey AS symbol, round(sum(l_extendedprice) / sum(l_quantity), 6) AS close, round(sum(l_extendedprice), 4) AS volume,
        round((avg(l_discount) - 0.05) * 1e4, 6) AS funding, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS taker, count(*) >= 3 AS complete FROM lineitem GROUP BY 1, 2)""",
    "funding": "funding AS (SELECT o_custkey % 10 AS symbol, epoch_us(o_orderdate) // 1000 AS ts, round(o_totalprice % 100 - 50, 4) AS bps, o_orderkey AS seq FROM orders)",
    "tiers": "tiers AS (SELECT DISTINCT ((p_size - 1) // 10 * 10)::DOUBLE AS min_size, ((p_size - 1) // 10 * 10 + 10)::DOUBLE AS max_size, 0.005::DOUBLE * ((p_size - 1) // 10 + 1) AS mmr FROM part)",
    "positions": """positions AS (SELECT l_orderkey AS "user", l_returnflag AS coin, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE -1.0 END::DOUBLE * l_quantity AS size, l_extendedprice / l_quantity AS entry,
        CASE WHEN l_discount > 0 THEN l_extendedprice / l_quantity * (1 - CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE -1.0 END::DOUBLE * l_discount * 4) END AS liq, l_extendedprice AS value FROM lineitem)""",
}


def sql(body: str, *names: str) -> str:
    """body with the named views (and those they need) in front of it."""
    need: list[str] = []
    for n in names:
        if n in ("touches", "trades", "bars") and "ticks" not in need:
            need.append("ticks")
        if n not in need:
            need.append(n)
    head = ",\n".join(SQL[n] for n in need)
    # Rounding to six digits steps off the halves, as rounded() does.
    return re.sub(r", 6\)", " + 1e-9, 6)", f"WITH {head}\n{body}")

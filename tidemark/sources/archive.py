"""Readers and writers of archived market data."""

from __future__ import annotations

import csv
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume")


MAGIC = b"\x1f\x8b\x08"
#: Bytes that are inflated to tell a member's start from the same bytes inside compressed data, and of one step.
PROBE, STEP = 4096, 1 << 16


def _starts(data: bytes) -> list[int]:
    """Offsets where a gzip member may start: its first bytes inflate, or fail only where another start follows."""
    found, at = [], data.find(MAGIC)
    while at >= 0:
        found.append(at)
        at = data.find(MAGIC, at + 1)
    out: list[int] = []
    for k in range(len(found) - 1, -1, -1):
        piece = data[found[k] : found[k] + PROBE]
        _, _, good = _inflated(piece)
        if good == len(piece) or (out and found[k] + good >= out[-1]):
            out.append(found[k])
    return out[::-1]


def _inflated(data: bytes) -> tuple[bytes, bool, int]:
    """(text, did the member end, bytes used before its end or a fault): a fault loses nothing that came before it."""
    d, out, at, step = zlib.decompressobj(31), [], 0, STEP
    while at < len(data) and not d.eof:
        trial, piece = d.copy(), data[at : at + step]
        try:
            out.append(trial.decompress(piece))
        except zlib.error:
            if step == 1:
                return b"".join(out), False, at
            step = max(1, step // 16)
            continue
        d, at = trial, at + len(piece)
    return b"".join(out), d.eof, at - len(d.unused_data)


def gzip_members(data: bytes) -> tuple[list[bytes], list[tuple[str, int, int]]]:
    """(lines, damage) of concatenated gzip members; damage is (kind, start, end) in bytes of the file.

    tail: the last member has no end; torn: one stops where another starts; corrupt: one can't be decoded from `end` on,
    its check sum included; junk: bytes that are neither a member nor zeros. What can be decoded before a fault is
    kept, a last line without its newline too, and reading goes on at the next start.
    """
    lines: list[bytes] = []
    damage: list[tuple[str, int, int]] = []
    starts: list[int] | None = None
    at = 0
    while at < len(data):
        stop = len(data)
        if data.startswith(MAGIC, at):
            text, ended, used = _inflated(data[at:])
            if not ended:  # decoded again up to the next start: beyond it nothing is this member's
                starts = _starts(data) if starts is None else starts
                stop = next((s for s in starts if s > at), len(data))
                text, ended, used = _inflated(data[at:stop])
            lines += [x for x in text.split(b"\n") if x.strip()]
            if ended:
                at += used
                continue
            if at + used < stop:
                damage.append(("corrupt", at, at + used))
            else:
                damage.append(("tail" if stop == len(data) else "torn", at, stop))
        else:
            starts = _starts(data) if starts is None else starts
            stop = next((s for s in starts if s > at), len(data))
            if data[at:stop].strip(b"\0"):
                damage.append(("junk", at, stop))
        at = stop
    return lines, damage


def read_raw_archive(spark: SparkSession, path: str, files: str = "*.jsonl.gz") -> DataFrame:
    """(file, t, n, m, damage) of gzip JSON-line archives; lines that aren't records are skipped and counted as damage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                lines, damage = gzip_members(bytes(data))
                rows = []
                for x in lines:
                    try:
                        r = json.loads(x)
                        rows.append((file, int(r["t"]), int(r["n"]), json.dumps(r["m"]), None))
                    except (ValueError, KeyError, TypeError):
                        rows.append((file, None, None, None, "line"))
                rows += [(file, None, None, None, kind) for kind, _, _ in damage]
                yield pd.DataFrame(rows, columns=["file", "t", "n", "m", "damage"]).astype({"t": "Int64", "n": "Int64"})

    found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, "file string, t long, n long, m string, damage string")


def write_raw_archive(df: DataFrame, path: str) -> None:
    """Rows (inst, day, channel, hour, t, n, m) as gzip JSON lines by instrument, day, channel and hour, in (t, n) order."""
    out = df.repartition("inst", "day", "channel", "hour").sortWithinPartitions("inst", "day", "channel", "hour", "t", "n")
    out.write.partitionBy("inst", "day", "channel", "hour").option("compression", "gzip").json(path)


def read_channel(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """read_raw_archive of one channel's files `<channel>-<hour>[.rNNN].jsonl.gz`, with hour and restart (0 for a first file) from the name.

    Order by folder, hour, restart and n is the order of time.
    """
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    cut = lambda k: F.regexp_extract(name, r"^(.*)-(\d{2})(?:\.r(\d+))?\.jsonl\.gz$", k)
    return read_raw_archive(spark, path, f"{channel}-[0-9]*.jsonl.gz").where(cut(1) == channel).withColumn("channel", cut(1)).withColumn("hour", cut(2).cast("int")).withColumn("restart", F.coalesce(F.when(cut(3) != "", cut(3)).cast("int"), F.lit(0)))


def on_date(events: DataFrame, date: str) -> DataFrame:
    """Events received on one UTC date."""
    day = F.expr(f"unix_millis(timestamp'{date} 00:00:00Z')")
    return events.where((F.col("t") >= day) & (F.col("t") < day + 86_400_000))


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Kline CSV with or without a header: bad rows go, microsecond stamps become milliseconds; symbol is the file name's first part.

    Of rows of one symbol and close time the first stays: that of the file first by name, then of the earliest open.
    """
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    raw = spark.read.csv(path, schema=", ".join(f"{c} string" for c in KLINE)).withColumn("_file", file)
    num = raw.select("_file", F.split("_file", "[-.]")[0].alias("symbol"), *[F.expr(f"try_cast({c} as {'long' if c.endswith('time') else 'double'})").alias(c) for c in KLINE]).where("close_time is not null and open is not null and close > 0")
    ms = lambda c: F.when(F.col(c) > 100_000_000_000_000, F.floor(F.col(c) / 1000)).otherwise(F.col(c))
    num = num.withColumn("open_time", ms("open_time")).withColumn("close_time", ms("close_time"))
    first = F.min_by(F.struct(*[c for c in KLINE if c != "close_time"]), F.struct("_file", "open_time"))
    return num.groupBy("symbol", "close_time").agg(first.alias("r")).select("symbol", *[F.col("close_time") if c == "close_time" else F.col(f"r.{c}") for c in KLINE])


def read_zip_csv(spark: SparkSession, path: str, expected: tuple[str, ...] = ()) -> DataFrame:
    """CSV files, one in each zip; a zip with another number of them is an error.

    With expected columns: (file, each of them as text), by the header's names where the first row holds them all, else by
    place; shorter rows are dropped. Without: (file, cells).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    (name,) = [n for n in z.namelist() if n.endswith(".csv")]
                    rows = [x for x in csv.reader(io.StringIO(z.read(name).decode())) if x]
                if not expected:
                    yield pd.DataFrame({"file": [file] * len(rows), "cells": rows})
                    continue
                head = [x.strip() for x in rows[0]] if rows else []
                named = all(c in head for c in expected)
                place = [head.index(c) for c in expected] if named else list(range(len(expected)))
                kept = [(file, *[x[k] for k in place]) for x in rows[named:] if len(x) > max(place)]
                yield pd.DataFrame(kept, columns=["file", *expected])

    schema = "file string, " + (", ".join(f"`{c}` string" for c in expected) or "cells array<string>")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(run, schema)


def merged(channels: list[DataFrame], key: str = "inst") -> DataFrame:
    """Channels as one stream per key in (t, n) order."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out.repartition(key).sortWithinPartitions(key, "t", "n")

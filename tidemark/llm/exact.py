"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get equal integer names by sorting the distinct
repeated blocks; then adjacent names are paired and the pairs named in the same way, again and again, until one name
is left. Two texts with the same number of blocks and the same last name are equal byte for byte: every name stands
for one content, so nothing rests on a hash. A hash only routes blocks to their names, and a routing value that two
contents share is resolved by content. A document holding a block (or pair) that occurs nowhere else
cannot have a copy and leaves the rounds at once, so the later rounds see copies only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidemark.llm.common import documents, private, written

BLOCK = 4096
#: Bytes of a block that its place in the order begins with.
HEAD = 16


def _blocks(rows: DataFrame, block: int, route) -> DataFrame:
    """(doc_id, sha, n, pos, h, blk): binary slices are taken by offset; the text itself is not copied to each block."""
    raw = F.col("raw")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.substring(raw, i * block + 1, F.lit(block)))
    return rows.select("doc_id", "sha", "n", F.posexplode(cut).alias("pos", "blk")).withColumn("h", route(F.col("blk")))


def _keyed(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.encode(text, "UTF-8")
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(raw, 256).alias("sha"), F.ceil(F.length(raw) / block).cast("int").alias("n"), raw.alias("raw"))


def _sorted_names(contents: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows of contents with an integer name by their place in the order of the columns `by`, which tell them apart.

    The driver samples `by` to deal rows to ranges, so it holds no whole block.
    """
    parts = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contents.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _first_names(blocks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Names of repeated blocks by h, and for values of h that several contents share, by (h, blk)."""
    # Distinct contents with their counts (combined before the shuffle); the content goes on only where it repeats.
    counted = blocks.groupBy("h", "blk").agg(F.count(F.lit(1)).alias("c"))
    slim = counted.select("h", "c", F.when(F.col("c") > 1, F.col("blk")).alias("blk"))
    by_h = slim.groupBy("h").agg(F.count(F.lit(1)).alias("contents"), F.max("c").alias("c"), F.max("blk").alias("blk"))
    by_h = written(by_h.where("c > 1 or contents > 1"), "block-contents")
    # Sorted by the first bytes, then by h, which has one content here.
    head = F.substring("blk", 1, HEAD).alias("head")
    names = _sorted_names(by_h.where("contents = 1").select("h", head), ["head", "h"]).select("h", "name")
    names = written(names, "block-names")
    # 64-bit routing values shared by different contents: n^2 / 2^65 of them, none to speak of below 10^9 blocks and
    # about 27,000 among 10^12, so that the driver holds some hundred kilobytes.
    collided = [r.h for r in by_h.where("contents > 1").select("h").collect()]
    if not collided:
        return names, None
    several = blocks.where(F.col("h").isin(collided)).groupBy("h", "blk").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    several = _sorted_names(several.select("h", "blk"), ["blk"]).withColumn("name", -1 - F.col("name"))
    return names, written(several, "block-names-collided")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, route=F.xxhash64) -> DataFrame:
    """(doc_id, sha, n, name) of each distinct (doc_id, text) that may have copies; others are missing and unique.

    n is the number of blocks; equal (n, name) means equal texts. sha is carried because the results need it and tells
    the texts of one doc_id apart. Every whole text is read; null counts as empty. route is a parameter for tests.
    """
    rows = _keyed(docs, id_col, text_col, block)
    blocks = _blocks(rows, block, route)
    names, collided = _first_names(blocks)
    slim = blocks.select("doc_id", "sha", "n", "pos", "h")
    if collided is None:
        named = slim.join(names, "h", "left")
    else:
        keys = [r.h for r in collided.select("h").distinct().collect()]
        plain = slim.where(~F.col("h").isin(keys)).join(names, "h", "left")
        apart = blocks.where(F.col("h").isin(keys)).join(collided, ["h", "blk"], "left").drop("blk")
        named = plain.unionByName(apart)
    # One row per document from here: names in order, only where all of its blocks repeat.
    lists = named.groupBy("doc_id", "sha", "n").agg(F.collect_set(F.when(F.col("name").isNotNull(), F.struct("pos", "name"))).alias("names"))
    whole = F.size("names") == F.greatest(F.col("n"), F.lit(1))
    level = written(lists.where(whole).select("doc_id", "sha", "n", F.transform(F.array_sort("names"), lambda x: x["name"]).alias("names")), "names-0")
    done = [level.where(F.size("names") == 1).select("doc_id", "sha", "n", F.col("names")[0].alias("name"))]
    todo, k = level.where(F.size("names") > 1), 0
    while not todo.isEmpty():
        k += 1
        half = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(i.alias("pos"), F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-(1 << 62))).alias("b")))
        pairs = todo.select("doc_id", "sha", "n", F.inline(half).alias("pos", "a", "b"))
        repeated = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "b")
        named = pairs.join(written(_sorted_names(repeated, ["a", "b"]), f"pair-names-{k}"), ["a", "b"], "left")
        lists = named.groupBy("doc_id", "sha", "n").agg(F.count(F.lit(1)).alias("m"), F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name"))).alias("names"))
        level = written(lists.where(F.size("names") == F.col("m")).select("doc_id", "sha", "n", F.transform(F.array_sort("names"), lambda x: x["name"]).alias("names")), f"names-{k}")
        done.append(level.where(F.size("names") == 1).select("doc_id", "sha", "n", F.col("names")[0].alias("name")))
        todo = level.where(F.size("names") > 1)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, route=F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; null texts equal the empty text; a null doc_id is smaller
    than any other. Of repeated rows (same doc_id and text) exactly one can stay. An empty table gives an empty result.
    Other columns of docs, whatever their names, are not read.
    """
    ids = identities(docs, id_col, text_col, block, route)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha")).groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("copies"))
    r, i = rows.alias("r"), ids.alias("i")
    joined = r.join(i, F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("r.sha") == F.col("i.sha")), "left")
    joined = written(joined.select("r.doc_id", "r.sha", "r.copies", "i.n", "i.name"), "exact-rows")
    groups = joined.where("name is not null").groupBy("n", "name").agg(F.max("doc_id").alias("top"), F.sum("copies").alias("total"))
    out = joined.where("name is not null").join(groups, ["n", "name"]).select("doc_id", "sha", "copies", "top", "total")
    out = out.unionByName(joined.where("name is null").select("doc_id", "sha", "copies", F.col("doc_id").alias("top"), F.col("copies").alias("total")))
    out = out.select("doc_id", F.col("top").alias("keep_id"), F.col("total").cast("long").alias("group_size"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k"), F.col("sha").alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without the rows that exact_groups drops; columns as they were.

    Of rows with one id and text the first by its other columns stays (maps aside). Nulls are as in exact_groups; an
    empty table stays empty; no column name clashes.
    """
    key = private(docs, "text_sha")
    sha = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    groups = exact_groups(docs, id_col, text_col, block)
    drop = groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s")).alias("x")
    d = docs.withColumn(key, sha).alias("d")
    kept = d.join(drop, F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.i")) & (F.col(f"d.`{key}`") == F.col("x.s")), "left_anti")
    order = [f"`{f.name}`" for f in docs.schema if not isinstance(f.dataType, MapType)]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*[F.col(c) for c in order]))
    return kept.groupBy(F.col(f"`{id_col}`").alias("i"), F.col(key).alias("s")).agg(first.alias("row")).select("row.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """exact_groups of all documents; nulls, ties, empty and repeated rows as there."""
    return exact_groups(documents(spark, sf_dir))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) AS rn FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM g
"""

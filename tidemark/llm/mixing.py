"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of all words. A source whose share exceeds `epochs` times its own words is
held there, and the excess goes to the others by weight until none is above. Each source then gives whole repetitions
of all of its documents and a fractional one: documents in a seeded order until the target is reached, the last of
them in part. The order is a hash, so reruns agree and the prefix sums are taken over hash buckets: no source is
sorted in one task, and only the one bucket per source that holds the boundary is ordered document by document.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, documents, private, written

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 42
#: Hash buckets of a source, as leading hex digits.
DIGITS = 3


def water_fill(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size) with their target, one row per source.

    Weights repeat over the sources by code point, null last. Works on the summary, one row for each source.
    """
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", pick).withColumn("cap", F.col("source_size") * epochs)
    everything = Window.partitionBy()
    s = s.withColumn("t", F.sum("source_size").over(everything)).withColumn("ws", F.sum("w").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    cap0, w0 = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("held", (F.col("t") - cap0).cast("double") / (F.col("ws") - w0) * F.col("w") > F.col("cap"))
    held_cap = F.sum(F.when(F.col("held"), F.col("cap")).otherwise(0)).over(everything)
    held_w = F.sum(F.when(F.col("held"), F.col("w")).otherwise(0)).over(everything)
    level = F.try_divide((F.col("t") - held_cap).cast("double"), F.col("ws") - held_w)  # null where every source is held
    return s.withColumn("target", F.when(F.col("held"), F.col("cap").cast("double")).otherwise(level * F.col("w"))).select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, reps, part.

    size: words of the whole text, 0 for null. A document gives reps whole repetitions and part words of another one;
    taken = reps * size + part <= epochs * size. A source's taken words are its target's whole words. Null is a source
    of its own, last. Repeated rows each count; which of several equal ones is taken makes no difference. A source
    without words has target 0. An empty table gives an empty result; other columns are not read.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("o"))
    rows = written(rows, "mix-sizes")
    bucket = F.substring("o", 1, DIGITS)
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    targets = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    targets = targets.withColumn("reps", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.floor("target") - F.col("reps") * F.col("source_size"))
    # (source, bucket): at most 16^DIGITS rows for a source, however many documents it has.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("key")
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "bucket", "words").withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    plan = sums.join(targets.select(key, "source_size", "target", "reps", "rest"), "key")
    plan = written(plan, "mix-plan")
    at = F.when(F.col("before") + F.col("words") <= F.col("rest"), F.lit("whole")).when(F.col("before") >= F.col("rest"), F.lit("none")).otherwise(F.lit("edge"))
    placed = rows.select("doc_id", "source", "size", "o", key, bucket.alias("bucket")).join(plan, ["key", "bucket"]).withColumn("at", at)
    even = placed.where("at <> 'edge'").withColumn("part", F.when(F.col("at") == "whole", F.col("size")).otherwise(F.lit(0)))
    within = Window.partitionBy("key", "bucket").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    edge = placed.where("at = 'edge'").withColumn("part", F.least(F.greatest(left, F.lit(0)), F.col("size")))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("reps") * F.col("size") + F.col("part")).cast("long").alias("taken"), "reps", F.col("part").cast("long").alias("part")]
    return even.select(*columns).unionByName(edge.select(*columns))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix repeats it; a part of half a document or more is a whole repetition.

    Rows equal in id, source and size share one decision. Null texts have no words, so they go unless their source is
    taken whole; nulls, ties and repeated rows otherwise as in mix. An empty table stays empty; no column name clashes.
    """
    m = mix(docs, id_col, text_col, source_col, weights, epochs, seed)
    times = (F.col("reps") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)).cast("int")
    # As many decisions as rows equal in id, source and size: one for all of them keeps the join one to one.
    times = m.groupBy(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n")).agg(F.max(times).alias("times")).alias("x")
    words = private(docs, "words")
    d = docs.withColumn(words, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")).alias("d")
    on = F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.i")) & F.col(f"d.`{source_col}`").eqNullSafe(F.col("x.s")) & (F.col(f"d.`{words}`") == F.col("x.n"))
    out = d.join(times, on).where("x.times > 0").select("d.*", F.explode(F.sequence(F.lit(1), F.col("x.times"))).alias(private(docs, "words_")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """mix of all documents without its inner columns; nulls, ties, empty and repeated rows as there."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('42:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM s),
x AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS t, (sum(w) OVER ())::BIGINT AS ws,
             coalesce(sum(cap) OVER b, 0)::BIGINT AS cap0, coalesce(sum(w) OVER b, 0)::BIGINT AS w0
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (t - cap0)::DOUBLE / (ws - w0) * w > cap AS held FROM x),
l AS (SELECT *, (t - (sum(CASE WHEN held THEN cap ELSE 0 END) OVER ())::BIGINT)::DOUBLE
                / (ws - (sum(CASE WHEN held THEN w ELSE 0 END) OVER ())::BIGINT) AS level FROM h),
t AS (SELECT source, source_size, CASE WHEN held THEN cap::DOUBLE ELSE level * w END AS target FROM l),
r AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS reps FROM t),
j AS (SELECT d.*, r.source_size, r.target, r.reps, floor(r.target)::BIGINT - r.reps * r.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, reps * size + least(greatest(rest - before, 0), size) AS taken FROM j
"""

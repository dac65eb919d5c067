"""What the corpus operators share: input columns, tables in the shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows that goes to Python, about.
BATCH_BYTES = 1 << 21


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.written_path = path
    return out


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on batches that this session sends to Python have about `most` bytes, or fewer if it says so itself.

    By default a batch has 64 MB or 10,000 rows, so a task's texts are often one batch, of which the executor and its
    Python worker hold several copies, and idle workers keep that memory. No result depends on batches.
    """
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made; whatever reads them must have been written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def private(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, src: str = "a", dst: str = "b", name: str = "components") -> DataFrame:
    """Connected components of an undirected edge list as (node, component): component is the smallest node reachable.

    Large-star/small-star rounds: each round is two groupings over the edges, none holds a component in one row.
    Rounds end when the edge set is a star forest (its checksum no longer changes). Empty edges give an empty frame.
    Self loops and repeated edges are harmless; nulls are ignored.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, e = e, written(small.where("a <> b").distinct(), name)
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)

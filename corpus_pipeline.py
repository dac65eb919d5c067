"""A corpus pipeline of five stages, each one of the corpus operators.

Nulls, empty and repeated rows, ties, empty tables and extra columns go as the operator of each stage says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact, langid, mixing, simhash
from tidemark.llm.common import bound_batches, documents, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stages share executors, whose Python workers stay: the session's batches for Python get small, and remain so."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier rejects go; it learns from labelled documents outside the held-out fold."""
    return langid.drop_rejected(docs, langid.train_outside_fold(docs))


@bounded
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact.exact_dedup(docs)


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8 or more) one stays."""
    return simhash.near_dedup(docs, table=True)  # each stage reads what the one before has written


@bounded
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources repeats them."""
    return mixing.mixed_documents(docs)


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length and digests of each document's token ids."""
    return bpe.encode_digests(docs)


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("mixing", mixture), ("BPE", encode)]

#: The classifier, SimHash and BPE stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written and read again, so a lost executor costs one stage at most."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

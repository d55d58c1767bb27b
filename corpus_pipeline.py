"""Documents to packed training sequences: each stage works on what the one before kept and is written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from clientpulse.llm.exact_dedup import drop_exact
from clientpulse.llm.jaccard_join import drop_near
from clientpulse.llm.language_id import drop_rejected
from clientpulse.llm.packing import pack
from clientpulse.llm.substring_dedup import drop_passages
from clientpulse.session import materialize


ROWS_PER_BATCH = 1000  # whole texts are long: Spark's 10,000 rows a batch take tens of MB in the JVM and in Python, for each task


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with at most ``ROWS_PER_BATCH`` rows in what its tasks hand to Python, a session setting that stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(key, "10000"))
        spark.conf.set(key, str(min(now, ROWS_PER_BATCH) if now > 0 else ROWS_PER_BATCH))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows without a language go."""
    return drop_rejected(docs)


@small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row of each group of equal texts stays."""
    return drop_exact(docs)


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the smallest id of each linked group stays. Sets are of five-word shingles, linked from 80 percent on."""
    return drop_near(docs, size=5, least=80)


@small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: passages of 50 words that an earlier document has are cut out; every document stays."""
    return drop_passages(docs)


@small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of documents with their place in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # fitted language likelihoods and bin packing have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Tables stored in buckets of their key, so that joins on it read both sides in place."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.session import scratch_path


def write_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Write a table bucketed and sorted by ``keys``; returns its name in the session's catalog.

    The rows are dealt by the same hash first, so that every bucket is one file and not one per task.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").format("parquet")
    writer.option("path", path or scratch_path(spark, name)).saveAsTable(name)
    return name


def co_located(spark: SparkSession, base: str, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Left join of bucketed tables on their bucket key; no side is moved."""
    out = spark.table(base).hint("merge")
    for name in features:
        out = out.join(spark.table(name).hint("merge"), list(keys), "left")
    return out


def exchanges(df: DataFrame) -> int:
    """How many exchanges the physical plan has, before anything runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line for line in plan.splitlines())


def bucket_counts(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``bucket, n``: rows per bucket, to choose their number by."""
    return df.groupBy(F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

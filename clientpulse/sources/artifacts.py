"""JSON artifacts as typed rows: selected features and reasons (A4, A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientpulse.sources.schemas import FEATURE_LISTS, REASONS


def write_feature_lists(lists: DataFrame, path: str) -> None:
    """``product, features`` rows as JSON lines."""
    lists.select("product", "features").write.mode("overwrite").json(path)


def read_feature_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_LISTS).json(path)


def write_reasons(reasons: DataFrame, path: str) -> None:
    """``client_id, product_id, reasons`` rows as JSON lines, keys kept as typed columns."""
    reasons.select("client_id", "product_id", "reasons").write.mode("overwrite").json(path)


def read_reasons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REASONS).json(path)

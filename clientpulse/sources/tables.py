"""Parquet scans and sinks, product/split output layout, literal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet directory as a DataFrame; a declared schema spares the footer read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite ``path`` with ``df``; a partitioned layout lets later reads prune directories."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_split(masters: dict[int, tuple[DataFrame, DataFrame]], path: str) -> None:
    """All products' train and test tables under one directory, partitioned by (product, split).

    Products select different features; columns a product lacks are null in its partitions.
    """
    parts = [
        part.withColumns({"product": F.lit(product), "split": F.lit(split)})
        for product, pair in masters.items()
        for split, part in zip(("train", "test"), pair)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    write_table(whole, path, ("product", "split"))


def read_split(spark: SparkSession, path: str, product: int, split: str) -> DataFrame:
    """One product and split; only that directory is listed in the scan."""
    rows = spark.read.parquet(path).filter((F.col("product") == product) & (F.col("split") == split))
    return rows.drop("product", "split")


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A small table written out in code, such as a portfolio."""
    return spark.createDataFrame(list(rows), schema)

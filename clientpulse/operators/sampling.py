"""Fraction samples, stratified down-sampling and class weights (K1, K4, K7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.functions.scalars import hash_key, hash_uniform
from clientpulse.operators.ordered import ranked


def fraction_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose key hash falls below the fraction: the same rows on every run, and whole keys stay together."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return df if fraction == 1 else df.filter(hash_uniform(seed, *keys) < fraction)


def cluster_quotas(class0: DataFrame, class1: DataFrame, strata: str, ratio: float) -> DataFrame:
    """``strata, n, pct, quota``: class-0 rows to keep per stratum so that class 0 makes up ``ratio`` of the sample."""
    sizes = class0.groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
    size0 = class0.agg(F.count(F.lit(1)).alias("n")).scalar()
    size1 = class1.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = F.round(F.lit(ratio / (1 - ratio)) * size1)
    share = F.try_divide(F.col("n"), size0)
    return sizes.select(strata, "n", share.alias("pct"), F.round(wanted * share).cast("long").alias("quota"))


def pick_quota(class0: DataFrame, quotas: DataFrame, strata: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The first ``quota`` rows of each stratum in md5 order.

    There are only a few strata, so a window per stratum would put a third of the table into one task; the positions
    come from a range-partitioned rank instead. Quotas have one row per stratum, so Spark may broadcast them.
    """
    keyed = class0.withColumn("__order", hash_key(seed, *keys))
    placed = ranked(keyed, [strata], ["__order", *keys], "__place")
    kept = placed.join(quotas.select(strata, "quota"), strata).filter(F.col("__place") <= F.col("quota"))
    return kept.drop("__order", "__place", "quota")


def stratified_sample(
    class0: DataFrame, class1: DataFrame, strata: str, keys: Sequence[str], ratio: float = 0.625, seed: int = 42
) -> DataFrame:
    """Class 1 whole and class 0 down-sampled by stratum: ``keys, class``."""
    quotas = cluster_quotas(class0, class1, strata, ratio)
    kept0 = pick_quota(class0.select(*keys, strata), quotas, strata, keys, seed).select(*keys, F.lit(0).alias("class"))
    return class1.select(*keys, F.lit(1).alias("class")).unionByName(kept0)


def balanced_weight(df: DataFrame, target: str, root: int = 1, name: str = "weight") -> DataFrame:
    """Weight (n0/n1)^(1/root) for positives and 1 for the rest; the counts are one scalar aggregate."""
    counts = df.agg(F.try_divide(F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)).alias("r")).scalar()
    return df.withColumn(name, F.when(F.col(target) == 1, F.pow(counts, F.lit(1.0 / root))).otherwise(1.0))

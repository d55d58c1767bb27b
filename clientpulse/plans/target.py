"""Stratification features, clusters, look-ahead label, observable horizon."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.functions.dates import period_start
from clientpulse.operators.history import lookahead_max, timeline, trailing
from clientpulse.operators.sampling import stratified_sample
from clientpulse.prep import Scaler, SignedLog
from clientpulse.session import materialize

KEY = ["client_id", "mon"]
STRATA_FEATURES = [
    "total_trans",
    "diff_trans_date",
    "avg_trans_3m",
    "avg_trans_6m",
    "std_trans_6m",
    "min_trans_date_6m",
    "max_trans_date_6m",
    "avg_trans_date_3m",
    "avg_trans_date_6m",
]


def strata_features(purchase: DataFrame, flag: str, ahead: int = 4) -> DataFrame:
    """Purchase-ahead indicator and trailing activity per client-month.

    The three-month frames are three rows wide, and the date columns come from ``diff_trans_date``.
    """
    span = timeline("client_id", "mon")
    bought = F.when(F.col(flag) > 0, 1).otherwise(0)
    monthly = (
        purchase.withColumn("__bought", bought)
        .withColumn("__bought", lookahead_max(span, "__bought", ahead))
        .groupBy(*KEY)
        .agg(
            F.max("__bought").alias("ind_any_purchase"),
            F.sum("trans_count").alias("total_trans"),
            F.max("diff_trans_date").alias("diff_trans_date"),
        )
    )
    return monthly.withColumns(
        {
            "avg_trans_3m": trailing(span, "total_trans", "avg", 3),
            "avg_trans_6m": trailing(span, "total_trans", "avg", 6),
            "std_trans_6m": trailing(span, "total_trans", "std", 6),
            "min_trans_date_6m": trailing(span, "diff_trans_date", "min", 6),
            "max_trans_date_6m": trailing(span, "diff_trans_date", "max", 6),
            "avg_trans_date_3m": trailing(span, "diff_trans_date", "avg", 3),
            "avg_trans_date_6m": trailing(span, "diff_trans_date", "avg", 6),
        }
    )


def by_class(df: DataFrame, flag: str = "ind_any_purchase") -> tuple[DataFrame, DataFrame]:
    """Rows of class 0 and of class 1."""
    return df.filter(F.col(flag) == 0), df.filter(F.col(flag) == 1)


def reduced(
    df: DataFrame, cols: Sequence[str] = STRATA_FEATURES, k: int = 3
) -> DataFrame:
    """Signed log, standard scale, nulls to 0, then ``k`` principal components fitted on all rows."""
    cols = list(cols)
    tidy = Pipeline(stages=[SignedLog(inputCols=cols), Scaler(inputCols=cols, kind="standard")]).fit(df)
    vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(tidy.transform(df).na.fill(0.0, cols))
    pca = PCA(k=k, inputCol="v", outputCol="components").fit(vectors)
    return pca.transform(vectors).drop("v")


def clusters(reduced_rows: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """K-means label of every client-month, joined by its own row and not by position."""
    model = KMeans(k=k, seed=seed, featuresCol="components", predictionCol="cluster").fit(reduced_rows)
    return model.transform(reduced_rows).select(*KEY, "cluster")


def observable(df: DataFrame, months: int = 4, time_col: str = "mon") -> DataFrame:
    """Rows whose look-ahead window is complete: not later than the last month minus ``months``."""
    last = df.agg(F.add_months(F.max(time_col), -months).alias("last")).scalar()
    return df.filter(F.col(time_col) <= last)


def lookahead_label(
    purchase: DataFrame,
    flag: str,
    target: str,
    ahead: int = 4,
    sampled: DataFrame | None = None,
    label_after_sampling: bool = False,
) -> DataFrame:
    """``client_id, mon, <target>``: a purchase within this row and the next ``ahead`` rows, on observable months.

    The label looks over the full history unless ``label_after_sampling`` asks for the sampled rows only.
    """
    span = timeline("client_id", "mon")
    keys = None if sampled is None else sampled.select(*KEY)
    rows = purchase.join(keys, KEY, "left_semi") if keys is not None and label_after_sampling else purchase
    # the horizon is that of the history, not of the sample, which may lack the last months
    labelled = observable(rows.withColumn(target, lookahead_max(span, flag, ahead)), ahead)
    if keys is not None and not label_after_sampling:
        labelled = labelled.join(keys, KEY, "left_semi")
    return labelled.select("client_id", period_start("mon").alias("mon"), target)


def lookahead_labels(purchase: DataFrame, targets: Mapping[str, str], ahead: int = 4) -> DataFrame:
    """``lookahead_label`` of several flags in one pass: ``client_id, mon`` and one column for each ``target -> flag``."""
    span = timeline("client_id", "mon")
    labelled = observable(purchase.withColumns({t: lookahead_max(span, flag, ahead) for t, flag in targets.items()}), ahead)
    return labelled.select("client_id", period_start("mon").alias("mon"), *targets)


def build_target(purchase: DataFrame, product: int, ratio: float = 0.625, seed: int = 42) -> DataFrame:
    """Label table of one product: strata features, clusters of class 0, stratified sample, label."""
    flag = f"target_{product}"
    features = materialize(strata_features(purchase, flag), "strata")
    class0, class1 = by_class(features)
    strata = clusters(materialize(reduced(class0), "reduced"), seed=seed)
    sample = stratified_sample(strata, class1, "cluster", KEY, ratio, seed)
    return lookahead_label(purchase, flag, flag, sampled=materialize(sample, "sample"))


def latest(df: DataFrame, time_col: str = "mon") -> DataFrame:
    """Rows of the last period only; the scalar reaches the scan as a filter."""
    last = df.agg(F.max(time_col).alias("last")).scalar()
    return df.filter(F.col(time_col) == last)



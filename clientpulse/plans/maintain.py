"""Purchase features kept up month by month instead of built anew.

A client's features of a month need its last few rows and what has been added up before them. Both are the **state**: per client
the last ``LOOKBACK`` rows, the running totals up to the row before them and the month of the last purchase before them. A
month then reads the new rows and the state after the month before, and writes its own partition of the features and of the state.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientpulse.functions.dates import month_gap, period_start
from clientpulse.operators.history import timeline
from clientpulse.plans.features import feats_purchase

# The longest frame of the features: six rows with the present one.
LOOKBACK = 5
FLAGS = [f"target_{k}" for k in range(1, 5)]
TOTALS = [f"total_{k}" for k in range(1, 5)]


def advance(spark: SparkSession, purchase: DataFrame, root: str, month: date, last: date | None = None) -> DataFrame:
    """Features of the rows of ``month`` (up to the month ``last``), written to ``root/features/mon=...``; returns them.

    Months have to come in order: the state of the latest month before them is read. Repeating months replaces them. ``purchase`` may
    hold any months; only the rows of these are read.
    """
    last = last or month
    new = purchase.filter(F.trunc("mon", "month").between(F.lit(month), F.lit(last))).withColumn("mon", period_start("mon"))
    rows = new.select("client_id", "mon", *FLAGS, "trans_count", "diff_trans_date", F.lit(True).alias("fresh"))
    state = _state_before(spark, root, month)
    if state is None:
        known = rows.withColumns({t: F.lit(0).cast("long") for t in TOTALS}).withColumn("bought_before", F.lit(None).cast("date"))
    else:
        held = state.select("client_id", F.inline("rows"), *TOTALS, "bought_before").withColumn("fresh", F.lit(False))
        totals = state.select("client_id", *TOTALS, "bought_before")
        fresh = rows.join(totals, "client_id", "left").na.fill(0, TOTALS)
        known = fresh.unionByName(held.select(*fresh.columns))
    done = features_of(known)
    # only the partitions of these months are replaced
    done.write.partitionBy("mon").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/features")
    _next_state(known).write.mode("overwrite").parquet(f"{root}/state/mon={last:%Y-%m-%d}")
    closed = F.col("mon").between(F.add_months(F.lit(month), 1), F.add_months(F.lit(last), 1))
    return spark.read.schema(done.schema).parquet(f"{root}/features").filter(closed)


def features_of(known: DataFrame) -> DataFrame:
    """``feats_purchase`` of the fresh rows among the rows known of each client, with what was added up before them."""
    built = feats_purchase(known.select("client_id", "mon", *FLAGS, "trans_count", "diff_trans_date"))
    own = known.filter("fresh").select("client_id", F.add_months("mon", 1).alias("mon"), *TOTALS, "bought_before")
    joined = built.join(own, ["client_id", "mon"])
    added = {f"pur_product_{k}_rsum_m": F.col(f"pur_product_{k}_rsum_m") + F.col(f"total_{k}") for k in range(1, 5)}
    # months since the last purchase: of the rows at hand, else of those before them; both dates are one period early
    since = month_gap(F.add_months("mon", -1), F.col("bought_before"))
    added["pur_recency_purchase"] = F.coalesce("pur_recency_purchase", since)
    return joined.withColumns(added).select(*built.columns)


def _next_state(known: DataFrame) -> DataFrame:
    """Per client its last rows, and the totals and last purchase of everything before them."""
    newest = W.partitionBy("client_id").orderBy(F.desc("mon"))  # at most LOOKBACK rows of the state and the new months
    placed = known.withColumn("place", F.row_number().over(newest))
    kept = F.col("place") <= LOOKBACK
    row = F.struct("mon", *FLAGS, "trans_count", "diff_trans_date")
    bought = F.col("target_1") + F.col("target_2") + F.col("target_3") + F.col("target_4") > 0
    older = {t: F.max(t) + F.coalesce(F.sum(F.when(~kept, F.col(f))), F.lit(0)) for t, f in zip(TOTALS, FLAGS)}
    return placed.groupBy("client_id").agg(
        F.array_sort(F.collect_list(F.when(kept, row))).alias("rows"),
        *[v.cast("long").alias(t) for t, v in older.items()],
        F.greatest(F.max("bought_before"), F.max(F.when(~kept & bought, F.col("mon")))).alias("bought_before"),
    )


def _state_before(spark: SparkSession, root: str, month: date) -> DataFrame | None:
    """State of all clients after the latest month before this one."""
    try:
        states = spark.read.option("basePath", f"{root}/state").parquet(f"{root}/state")
    except AnalysisException:
        return None
    before = states.withColumn("mon", F.col("mon").cast("date")).filter(F.col("mon") < F.lit(month))
    last = before.agg(F.max("mon")).first()[0]
    return None if last is None else before.filter(F.col("mon") == F.lit(last)).drop("mon")

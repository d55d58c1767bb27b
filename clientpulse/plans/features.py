"""The four client-by-month feature tables.

Each ends with the leak guard: ``mon`` moves one month on, so a row only describes closed periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.functions.dates import is_day, is_night, period_start, shift_months
from clientpulse.functions.scalars import any_flag
from clientpulse.functions.vectors import cosine_distance, euclidean, l2_norm
from clientpulse.operators.history import (
    change_over,
    growth_streak,
    recency,
    running_sum,
    since_previous,
    timeline,
    trailing,
)
from clientpulse.operators.ordered import exact_quantiles, previous_row
from clientpulse.operators.rollup import category_profile, placed_counts, profile_columns
from clientpulse.session import materialize

KEY = ["client_id", "mon"]
# The three currency codes tracked one by one.
CURRENCIES = (11, 15, 3)


def close_period(df: DataFrame, months: int = 1) -> DataFrame:
    return df.withColumn("mon", shift_months("mon", months))


def trx_rollup(trx: DataFrame, currencies: Sequence[int] = CURRENCIES, accounts: bool = True) -> DataFrame:
    """Counts, amounts and category profiles per client and month, from one scan.

    Rows are first counted by the combination of their categories' values, then, where the client's combinations are, by value of each
    category; amounts are summed along with the currencies, so everything else is read off that table and moves nothing. Without ``accounts`` the profiles of source and destination are left out, and the rows they are counted from.
    """
    cats = {"day": "day", "event": "event_type", "currency": "currency"} | (
        {"src": "src_type11", "dst": "dst_type11"} if accounts else {}
    )
    dated = trx.withColumns({"mon": period_start("event_time"), "day": F.to_date("event_time")})
    counts = placed_counts(dated, KEY, "client_id", cats, "currency", "amount")
    paid, main = F.col("cat") == "currency", currencies[0]
    of = {c: paid & (F.col("val") == str(c)) for c in currencies}
    listed = F.coalesce(F.col("val").isin([str(c) for c in currencies]), F.lit(False))

    def total(rows: Column, col: str, zero) -> Column:
        return F.coalesce(F.sum(F.when(rows, F.col(col))), F.lit(zero))

    names = {
        "day_distinct": "trans_days_active_m",
        "event_distinct": "trans_type_trx_cnt_m",
        "currency_distinct": "trans_type_currency_cnt_m",
        "src_distinct": "trans_type_src_account_cnt_m",
        "dst_distinct": "trans_type_dst_account_cnt_m",
        "event_mode": "trans_event_type_mode_m",
        "event_entropy": "trans_event_type_entropy_m",
        "dst_mode": "trans_dst_type_mode_m",
        "dst_entropy": "trans_dst_type_entropy_m",
    }
    rolled = counts.groupBy(*KEY).agg(
        total(paid, "n", 0).alias("trans_trx_cnt_m"),
        *[total(of[c], "n", 0).alias(f"trans_trx_currency_{c}_cnt_m") for c in currencies],
        total(paid & ~listed, "n", 0).alias("trans_trx_others_currency_cnt_m"),
        *[total(of[c], "amt_sum", 0.0).alias(f"trans_amt_trx_currency_{c}_sum_m") for c in currencies],
        F.max(F.when(of[main], F.col("amt_avg"))).alias(f"trans_amt_currency_{main}_avg_m"),
        F.max(F.when(of[main], F.col("amt_std"))).alias(f"trans_amt_currency_{main}_std_m"),
        *profile_columns(cats, {p: dated.schema[c].dataType for p, c in cats.items()}),
    )
    profiles = {f"{p}_{kind}" for p in cats for kind in ("distinct", "entropy", "mode")}
    return rolled.select(
        *[F.col(c).alias(names.get(c, c)) for c in rolled.columns if c in names or c not in profiles]
    )


def feats_trx(trx: DataFrame, currencies: Sequence[int] = CURRENCIES, accounts: bool = True) -> DataFrame:
    """Transaction features; without ``accounts`` those of source and destination accounts are left out."""
    span = timeline("client_id", "mon")
    rolled = trx_rollup(trx, currencies, accounts)
    by_account = {"trans_dst_type_entropy_ravg_3m": trailing(span, "trans_dst_type_entropy_m", "avg", 3)} if accounts else {}
    with_history = rolled.withColumns(
        {
            "trans_trx_per_day_m": F.try_divide("trans_trx_cnt_m", "trans_days_active_m"),
            **by_account,
            "trans_event_type_entropy_ravg_3m": trailing(span, "trans_event_type_entropy_m", "avg", 3),
            **{f"trans_trx_cnt_roc_{k}m": change_over(span, "trans_trx_cnt_m", k) for k in (1, 3, 6, 12)},
            "trans_days_active_rstd_6m": trailing(span, "trans_days_active_m", "std", 6),
            "trans_ind_trx_multicurrency": F.when(F.col("trans_type_currency_cnt_m") > 1, 1).otherwise(0),
        }
    )
    return close_period(growth_streak(with_history, "client_id", "mon", "trans_trx_cnt_m", "trx_growth_streak_3m"))


def geo_rollup(geo: DataFrame, period: str = "month") -> DataFrame:
    """Pings, active days, day and night counts, distinct cells and cell entropy at three precisions."""
    dated = geo.select(
        "client_id",
        period_start("event_time", period).alias("mon"),
        F.to_date("event_time").alias("day"),
        is_day("event_time").alias("is_day"),
        is_night("event_time").alias("is_night"),
        "geohash_4",
        "geohash_5",
        "geohash_6",
    )
    base = dated.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("geo_ping_cnt_m"),
        F.sum("is_day").alias("geo_day_cnt_m"),
        F.sum("is_night").alias("geo_night_cnt_m"),
    )
    cats = {"day": "day", "g4": "geohash_4", "g5": "geohash_5", "g6": "geohash_6"}
    profile = category_profile(dated, KEY, cats).select(
        *KEY,
        F.col("day_distinct").alias("geo_days_active_m"),
        *[F.col(f"g{p}_distinct").alias(f"geo_geohash_{p}_cnt_m") for p in (4, 5, 6)],
        *[F.col(f"g{p}_entropy").alias(f"geo_geohash_{p}_entropy_m") for p in (4, 5, 6)],
    )
    return base.join(profile, KEY)


def feats_geo(geo: DataFrame, period: str = "month") -> DataFrame:
    span = timeline("client_id", "mon")
    out = geo_rollup(geo, period).withColumns(
        {
            "geo_days_active_avg_6m": trailing(span, "geo_days_active_m", "avg", 6),
            **{
                f"geo_geohash_{p}_rstd_6m": trailing(span, f"geo_geohash_{p}_entropy_m", "std", 6) for p in (4, 5, 6)
            },
            **{f"geo_geohash_6_roc_{k}m": change_over(span, "geo_geohash_6_cnt_m", k) for k in (1, 3, 6)},
            "geo_usage_per_day_m": F.try_divide("geo_ping_cnt_m", "geo_days_active_m"),
        }
    )
    return close_period(out)


def dialog_months(dialog: DataFrame) -> DataFrame:
    """Dialog rows with month, vector length and an order that has no ties between different vectors."""
    return dialog.select(
        "client_id",
        period_start("event_time").alias("mon"),
        "event_time",
        "embedding",
        l2_norm("embedding").alias("v_norm"),
        F.xxhash64("embedding").alias("tie"),
    )


def drift_aggs() -> list[Column]:
    """First and last vector of a group by time: aggregates, so no ranking and no join of two halves."""
    at = F.struct("event_time", "tie")
    return [F.min_by("embedding", at).alias("first_emb"), F.max_by("embedding", at).alias("last_emb")]


def first_last_drift(months: DataFrame) -> DataFrame:
    """Distance from the first to the last vector of the month."""
    ends = months.groupBy(*KEY).agg(*drift_aggs())
    return ends.select(*KEY, euclidean("first_emb", "last_emb").alias("dialog_drift_m"))


def consecutive_distances(months: DataFrame) -> DataFrame:
    """Cosine distance of each vector to the one before it in the same client-month."""
    linked = previous_row(months, KEY, ["event_time", "tie"], ["embedding", "v_norm"], "prev")
    return linked.filter(F.col("prev").isNotNull()).select(
        *KEY,
        "event_time",
        cosine_distance(
            "embedding", F.col("prev.embedding"), F.col("v_norm"), F.col("prev.v_norm")
        ).alias("cos_dist"),
    )


def moments(value: str, prefix: str) -> list[Column]:
    return [F.avg(value).alias(f"{prefix}_mean_m"), F.stddev(value).alias(f"{prefix}_std_m")]


def median_of(df: DataFrame, value: str, prefix: str) -> DataFrame:
    return exact_quantiles(df, KEY, value, {f"{prefix}_median_m": 0.5})


def score_summary(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """Mean, standard deviation and exact median of a derived score per client-month."""
    return df.groupBy(*KEY).agg(*moments(value, prefix)).join(median_of(df, value, prefix), KEY, "left")


def feats_dialog(dialog: DataFrame, summaries: bool = True) -> DataFrame:
    """Dialog features. Both medians come from one distribution of vector lengths and distances.

    Without ``summaries`` the distances between consecutive vectors and the medians, which need sorted copies, are left out.
    """
    months = dialog_months(dialog)
    base = months.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("dialog_cnt_m"),
        F.count_distinct("event_time").alias("dialog_days_active_m"),
        *moments("v_norm", "dialog_norm"),
        *drift_aggs(),
    )
    joined = base.withColumn("dialog_drift_m", euclidean("first_emb", "last_emb")).drop("first_emb", "last_emb")
    if summaries:
        distances = consecutive_distances(months)
        kind = F.lit("dialog_norm").alias("kind")
        values = months.select(*KEY, kind, F.col("v_norm").alias("value")).unionByName(
            distances.select(*KEY, F.lit("dialog_cos_dist").alias("kind"), F.col("cos_dist").alias("value"))
        )
        middle = exact_quantiles(values, [*KEY, "kind"], "value", {"median": 0.5})
        medians = middle.groupBy(*KEY).agg(
            *[F.max(F.when(F.col("kind") == k, F.col("median"))).alias(f"{k}_median_m") for k in ("dialog_norm", "dialog_cos_dist")]
        )
        joined = joined.join(medians, KEY, "left").join(distances.groupBy(*KEY).agg(*moments("cos_dist", "dialog_cos_dist")), KEY, "left")
    span = timeline("client_id", "mon")
    out = joined.withColumns(
        {
            "dialog_avg_per_day_m": F.try_divide("dialog_cnt_m", "dialog_days_active_m"),
            "dialog_drift_rstd_3m": trailing(span, "dialog_drift_m", "std", 3),
            "dialog_drift_rstd_6m": trailing(span, "dialog_drift_m", "std", 6),
            "dialog_recency_m": since_previous(span, "mon"),
        }
    )
    return close_period(out)


def feats_purchase(purchase: DataFrame) -> DataFrame:
    """Running product totals, purchase counts and recency. One row per client-month in and out."""
    span = timeline("client_id", "mon")
    flags = [f"target_{k}" for k in range(1, 5)]
    base = purchase.withColumn("mon", period_start("mon")).withColumns(
        {
            **{f"pur_product_{k}_rsum_m": running_sum(span, f"target_{k}") for k in range(1, 5)},
            "pur_any_purchase": any_flag(flags),
            **{f"pur_trans_count_avg_{k}m": trailing(span, "trans_count", "avg", k) for k in (3, 6)},
            **{f"pur_trans_count_std_{k}m": trailing(span, "trans_count", "std", k) for k in (3, 6)},
        }
    )
    out = base.withColumns(
        {
            "pur_recency_purchase": recency(span, "pur_any_purchase", "mon"),
            "pur_any_purchase_sum_3m": trailing(span, "pur_any_purchase", "sum", 4),
            "pur_any_purchase_sum_6m": trailing(span, "pur_any_purchase", "sum", 6),
        }
    )
    renamed = out.withColumnsRenamed({"diff_trans_date": "pur_diff_trans_date_m", "trans_count": "pur_trans_count_m"})
    return close_period(renamed.drop(*flags))

"""Master tables: label left-joined to features, temporal split, column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["client_id", "mon"]


def pick_columns(df: DataFrame, ids: Sequence[str], features: Sequence[str], target: str | None = None) -> DataFrame:
    """Ids, a feature list known only at run time, and the target; a missing column is an error."""
    wanted = [*ids, *features, *([target] if target else [])]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.select(*wanted)


def join_features(label: DataFrame, *features: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Left joins on the same key: every side is shuffled once and the label side is not shuffled again."""
    out = label
    for table in features:
        out = out.join(table, list(key), "left")
    return out


def split_start(df: DataFrame, test_share: float = 0.30, time_col: str = "mon") -> DataFrame:
    """``n_months, n_test, start``: the last training month, so that the floored share of months is tested."""
    months = df.select(time_col).distinct().agg(
        F.count(F.lit(1)).alias("n_months"), F.max(time_col).alias("last")
    )
    n_test = F.floor(F.col("n_months") * test_share).cast("int")
    return months.select("n_months", n_test.alias("n_test"), F.add_months("last", -n_test).alias("start"))


def temporal_split(
    df: DataFrame, base: DataFrame | None = None, test_share: float = 0.30, time_col: str = "mon"
) -> tuple[DataFrame, DataFrame]:
    """Train up to the start month of ``base`` (default: the table itself), test after it."""
    start = split_start(df if base is None else base, test_share, time_col).select("start").scalar()
    return df.filter(F.col(time_col) <= start), df.filter(F.col(time_col) > start)

"""Windows over a client's periods (E).

These expect one row per client and period, so a window partition is bounded by the number of periods and a plain
window is the right tool; raw event tables are rolled up first, or use ``operators.ordered``. All expressions on the
same key and order are added in one ``withColumns`` and share one shuffle and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientpulse.functions.dates import month_gap
from clientpulse.functions.scalars import rate_of_change

TRAILING = {"avg": F.avg, "std": F.stddev, "min": F.min, "max": F.max, "sum": F.sum}


def timeline(key: str | Sequence[str], order: str) -> WindowSpec:
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def trailing(span: WindowSpec, col: str | Column, fn: str, rows: int) -> Column:
    """``fn`` over this row and the ``rows - 1`` rows before it (rows, not calendar months)."""
    return TRAILING[fn](col).over(span.rowsBetween(1 - rows, 0))


def lookahead_max(span: WindowSpec, col: str | Column, rows: int = 4) -> Column:
    """Maximum over this row and the ``rows`` rows after it, i.e. ``rows + 1`` rows."""
    return F.max(col).over(span.rowsBetween(0, rows))


def running_sum(span: WindowSpec, col: str | Column) -> Column:
    return F.sum(col).over(span.rowsBetween(W.unboundedPreceding, 0))


def change_over(span: WindowSpec, col: str, rows: int) -> Column:
    """x / (x ``rows`` rows ago) - 1."""
    return rate_of_change(F.col(col), F.lag(col, rows).over(span))


def recency(span: WindowSpec, flag: str | Column, order: str) -> Column:
    """Months since the last earlier row on which the flag was set."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    seen = F.last(F.when(flag > 0, F.col(order)), ignorenulls=True)
    return month_gap(order, seen.over(span.rowsBetween(W.unboundedPreceding, -1)))


def since_previous(span: WindowSpec, order: str) -> Column:
    """Months since the client's previous row."""
    return month_gap(order, F.lag(order).over(span))


def growth_streak(df: DataFrame, key: str, order: str, col: str, name: str, rows: int = 3) -> DataFrame:
    """1 where the value has grown on each of the last ``rows`` rows, else 0."""
    span = timeline(key, order)
    grew = F.when(F.col(col) > F.lag(col).over(span), 1).otherwise(0)
    flagged = df.withColumn("__grew", grew)
    streak = F.sum("__grew").over(span.rowsBetween(1 - rows, 0))
    return flagged.withColumn(name, F.when(streak == rows, 1).otherwise(0)).drop("__grew")


def purchase_gaps(df: DataFrame, key: str, order: str, flags: dict[str, str]) -> DataFrame:
    """Months from one purchase to the next of the same product; ``flags`` maps product name to flag column.

    The flags are unpivoted first, so all products share one window instead of one job each.
    """
    named = df.select(key, order, *[F.col(c).alias(p) for p, c in flags.items()])
    bought = named.unpivot([key, order], list(flags), "product", "flag").filter(F.col("flag") > 0)
    gap = since_previous(timeline([key, "product"], order), order)
    return bought.withColumn("diff_months", gap).filter(F.col("diff_months").isNotNull()).drop("flag")

"""Calendar expressions (H1-H4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_start(col: str | Column, period: str = "month") -> Column:
    """First day of the period a date or timestamp falls in; weeks start on Monday."""
    return F.trunc(col, period)


def shift_months(col: str | Column, months: int) -> Column:
    """``add_months``; +1 on a feature table is the guard that keeps a month's features out of its own label."""
    return F.add_months(col, months)


def month_gap(later: str | Column, earlier: str | Column) -> Column:
    """Months between two dates, fractional with 31-day months where the days differ."""
    return F.months_between(later, earlier)


def is_night(col: str | Column) -> Column:
    """1 from 18:00 to 05:59, else 0."""
    return F.when((F.hour(col) >= 18) | (F.hour(col) < 6), 1).otherwise(0)


def is_day(col: str | Column) -> Column:
    """1 from 06:00 to 17:59, else 0."""
    return F.when((F.hour(col) >= 6) & (F.hour(col) < 18), 1).otherwise(0)

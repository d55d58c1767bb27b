"""Back-test calendars and temporal folds (L1-L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months per step of each monthly-based frequency.
MONTHS = {"monthly": 1, "bi_monthly": 2, "quarterly": 3, "semi_annually": 6, "yearly": 12}
FREQUENCIES = (*MONTHS, "weekly")


def _check(freq: str) -> None:
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency {freq!r}; choose one of {', '.join(FREQUENCIES)}")


def add_period(date: str | Column, freq: str) -> Column:
    """The date one period later."""
    _check(freq)
    return F.date_add(date, 7) if freq == "weekly" else F.add_months(date, MONTHS[freq])


def _at_or_after(date: Column, unit: str) -> Column:
    """First start of a month, quarter or year that is not before the date."""
    floor = F.trunc(date, unit)
    return F.when(floor == date, floor).otherwise(F.add_months(floor, {"month": 1, "quarter": 3, "year": 12}[unit]))


def calendar_array(start: Column, end: Column, freq: str) -> Column:
    """Array of back-test dates from ``start`` to ``end``, both dates of the same row."""
    _check(freq)
    if freq == "weekly":
        monday = F.date_add(F.trunc(start, "week"), F.when(F.trunc(start, "week") == start, 0).otherwise(7))
        step = F.expr("interval 7 days")
        first = monday
    else:
        unit = {"quarterly": "quarter", "yearly": "year"}.get(freq, "month")
        first, step = _at_or_after(start, unit), F.make_ym_interval(F.lit(0), F.lit(MONTHS[freq]))
    if freq == "bi_monthly":
        # every second business month start: the first weekday of the month, from the start date on
        months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
        weekday = F.transform(months, _first_weekday)
        inside = F.filter(weekday, lambda d: (d >= start) & (d <= end))
        return F.filter(inside, lambda d, i: i % 2 == 0)
    dates = F.when(first <= end, F.sequence(first, end, step))
    return F.coalesce(dates, F.array().cast("array<date>"))


def _first_weekday(month: Column) -> Column:
    day = F.dayofweek(month)
    return F.date_add(month, F.when(day == 7, 2).when(day == 1, 1).otherwise(0))


def calendar(bounds: DataFrame, freq: str, start: str = "start", end: str = "end") -> DataFrame:
    """One row per back-test date between the bounds of each input row, as ``cut``."""
    return bounds.select(F.explode(calendar_array(F.col(start), F.col(end), freq)).alias("cut"))


def _tag(rows: DataFrame, time_col: str, cuts: Column, part) -> DataFrame:
    """Rows with every fold they belong to. Folds come from inside the row: no join, no range condition.

    ``cuts`` is the array of fold dates; ``part`` says whether the row is train, test or out (null) for a date.
    """
    each = rows.withColumn("fold", F.explode(cuts))
    return each.withColumn("part", part(F.col(time_col), F.col("fold"))).filter(F.col("part").isNotNull())


def fold_dates(rows: DataFrame, time_col: str, freq: str, start: Column, end: Column) -> Column:
    """The calendar between two aggregates of the time column, as a scalar array."""
    bounds = rows.agg(start.alias("start"), end.alias("end"))
    return bounds.select(calendar_array(F.col("start"), F.col("end"), freq).alias("cuts")).scalar()


def expanding_folds(rows: DataFrame, time_col: str, cuts: Column, freq: str = "monthly") -> DataFrame:
    """Train on everything before the fold date, test on the period that starts on it."""

    def part(t: Column, d: Column) -> Column:
        return F.when(t < d, "train").when(t < add_period(d, freq), "test")

    return _tag(rows, time_col, cuts, part)


def rolling_folds(rows: DataFrame, time_col: str, cuts: Column, span: int = 1) -> DataFrame:
    """Train on the ``span`` months before the fold date, test on the month that starts on it."""

    def part(t: Column, d: Column) -> Column:
        return F.when((t >= F.add_months(d, -span)) & (t < d), "train").when(
            (t >= d) & (t < F.add_months(d, 1)), "test"
        )

    return _tag(rows, time_col, cuts, part)


def leaks(folds: DataFrame, time_col: str) -> DataFrame:
    """Folds whose latest training row is not before their earliest test row; should be empty."""
    ends = folds.groupBy("fold").agg(
        F.max(F.when(F.col("part") == "train", F.col(time_col))).alias("last_train"),
        F.min(F.when(F.col("part") == "test", F.col(time_col))).alias("first_test"),
    )
    return ends.filter(F.col("last_train") >= F.col("first_test"))


def assert_no_leak(folds: DataFrame, time_col: str) -> None:
    if not leaks(folds, time_col).isEmpty():
        raise ValueError("training rows overlap the test period")

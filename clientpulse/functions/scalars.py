"""Indicators, buckets, rates and hash-based random numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_flag(cols: Sequence[str]) -> Column:
    """1 if the flags add up to more than zero, else 0 (null flags make it 0)."""
    added = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return F.when(added > 0, 1).otherwise(0)


def keep_listed(col: str, listed: Sequence, other=0) -> Column:
    """The value if it is in the list, otherwise ``other``; null counts as not listed."""
    return F.when(F.col(col).isin(*listed), F.col(col)).otherwise(F.lit(other))


def rate_of_change(current: Column, earlier: Column) -> Column:
    """current / earlier - 1; null when the earlier value is zero or missing."""
    return F.try_divide(current, earlier) - F.lit(1.0)


def signed_log(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.signum(col) * F.log1p(F.abs(col))


def hash_uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) fixed by the row's keys and the seed.

    The first 12 hex digits of an md5 are used: exact in a double and the same on every engine and every retry.
    """
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def hash_key(seed: int, *keys: str | Column) -> Column:
    """An md5 of keys and seed, for a reproducible shuffled order."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def percent_text(col: str | Column) -> Column:
    """A share as a whole percent, halves to the even side, e.g. ``83%``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.concat(F.bround(col * 100).cast("int").cast("string"), F.lit("%"))

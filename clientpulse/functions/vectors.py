"""Array arithmetic with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: str | Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def subtract(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return l2_norm(subtract(a, b))


def cosine_distance(
    a: str | Column, b: str | Column, norm_a: Column | None = None, norm_b: Column | None = None
) -> Column:
    """1 - cosine similarity; null when either vector has no length."""
    norm_a = l2_norm(a) if norm_a is None else norm_a
    norm_b = l2_norm(b) if norm_b is None else norm_b
    return F.lit(1.0) - F.try_divide(dot(a, b), norm_a * norm_b)

"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, the lengths differ, or a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def rank_proxy(rank: Column, n: Column) -> Column:
    """1.0 for the first of n ranks down to 0.5 for the last."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(1.0 - (rank - 1) / (n - 1) * 0.5)

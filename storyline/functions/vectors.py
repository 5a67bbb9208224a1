"""Vector expressions on ``array<double>`` columns; they run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances are compared after rounding, so that sums in another order give the same choice.
DISTANCE_DIGITS = 12

#: Stands in for a zero length in a division.
TINY = 1e-300


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(sum_of_squares(v))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    values = v.cast("array<double>")
    # The length is repeated beside the values: inside a lambda it would be worked out again per element.
    length = F.greatest(norm(values), F.lit(TINY))
    return F.zip_with(values, F.array_repeat(length, F.size(values)), lambda x, n: x / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector is at distance 1 from everything."""
    return 1 - dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(TINY))


def sum_of_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)

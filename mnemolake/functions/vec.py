"""Vector expressions over ``array<float>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """``x`` as engines round doubles: scaled in doubles, halves away from zero.

    Spark's own ``round`` takes the shortest decimal form instead, which puts products such as 0.00465 * 0.05 below the half.
    """
    scale = F.lit(float(10**digits))
    return F.round(x * scale) / scale


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """zero when either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def time_decay(age_days: Column, e_folding_days: float, floor: float) -> Column:
    """whole days, never below the floor."""
    age = F.greatest(F.floor(age_days), F.lit(0))
    return F.greatest(F.exp(-age / F.lit(float(e_folding_days))), F.lit(floor))

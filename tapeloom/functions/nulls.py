"""The conventions for what is undefined: null while warming up, 0 for a statistic without spread, null for an absent side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def share(a: Column, b: Column) -> Column:
    """100 a / b, 0 where b is 0."""
    return F.coalesce(F.lit(100.0) * ratio(a, b), F.lit(0.0))


def sign(x: Column, band: float = 0.0) -> Column:
    """1, 0 or -1, 0 within a neutral band."""
    return F.when(x > band, 1).when(x < -band, -1).otherwise(0)


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate: 0 if fewer than 3 rows or one side is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(F.count(a) < 3, 0.0).otherwise(ratio0(F.covar_pop(a, b), spread))


def micro(x: Column) -> Column:
    """x to 6 places in plain floating point, for quotients that often lie halfway, where engines' round() differ."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def places(x: Column, n: int) -> Column:
    """x to n places; an x that rounds to 0 keeps its sign, as SQL's round() does and Spark's does not."""
    near = F.round(x, n)
    return F.when(near == 0, x * 0.0).otherwise(near)

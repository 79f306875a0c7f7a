"""Vector arithmetic on array columns, in double precision and a fixed order of summation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector raises."""
    n = norm(a)
    fine = F.when(n > 0, n).otherwise(F.raise_error(F.lit("vector of norm zero")).cast("double"))
    return F.transform(a, lambda x: x.cast("double") / fine)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_valid(a: Column, dimension: int) -> Column:
    """Right length, all components finite and not null, not zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimension) & finite & (norm(a) > 0), F.lit(False))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))

"""Column functions on arrays of float, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The sum of products in order; the cosine of normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector divided by its length; a zero vector stays as it is."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(1.0)))


def usable(v: Column, dims: int) -> Column:
    """Has a vector ``dims`` finite numbers, not all zero?"""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False))

"""Vector expressions on array columns: higher-order functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different lengths or of length zero."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v
    )


def unit_similarity(distance_squared: Column) -> Column:
    """Similarity of unit vectors by their squared distance, not below 0."""
    return F.greatest(F.lit(0.0), 1 - distance_squared / 2)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def four_decimals(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000

"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or zero, or lengths differ."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def overlap_fraction(expected: Column, found: Column) -> Column:
    """Share of expected names that contain, or are contained in, a found one; null without any expected."""
    hit = F.filter(expected, lambda e: F.exists(found, lambda f: F.contains(F.lower(f), F.lower(e)) | F.contains(F.lower(e), F.lower(f))))
    return F.when(F.size(expected) > 0, F.size(hit) / F.size(expected))

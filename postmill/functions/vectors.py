"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Products in the elements' type, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is all zero, an error if the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def round_half_up(c: Column, digits: int) -> Column:
    """Rounded so that ties go up, also for negative numbers."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale

"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a null or a zero vector or unequal lengths."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), 1 - dot(a, b) / both)


def l2_normalize(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def rrf(weight: float, k: int, rank: Column) -> Column:
    """weight / (k + rank), 0 without a rank."""
    return F.when(rank.isNotNull(), F.lit(float(weight)) / (F.lit(k) + rank)).otherwise(F.lit(0.0))


def quantize4(x: Column) -> Column:
    """Four decimals, half to even, decided on the number's shortest text."""
    return F.bround(x.cast("string").cast("decimal(20,10)"), 4).cast("decimal(5,4)")

"""Vectors as arrays of doubles: norms, distances, arithmetic, quantisation, rank fusion. All of it native higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(v: Column, step) -> Column:
    return F.aggregate(v, F.lit(0.0), step)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l1_norm(v: Column) -> Column:
    return _fold(v, lambda s, x: s + F.abs(x))


def linf_norm(v: Column) -> Column:
    return _fold(v, lambda s, x: F.greatest(s, F.abs(x)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (magnitude(a) * magnitude(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda s, x: s + x))


def l1_distance(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(k))


def normalize(v: Column) -> Column:
    """v at length 1; a zero vector stays as it is."""
    m = magnitude(v)
    return F.when(m == 0, v).otherwise(F.transform(v, lambda x: x / m))


def clip(v: Column, low: float, high: float) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def mean(v: Column) -> Column:
    return _fold(v, lambda s, x: s + x) / F.size(v)


def sparsity(v: Column, threshold: float = 0.0) -> Column:
    """Share of elements no larger than the threshold."""
    return F.size(F.filter(v, lambda x: F.abs(x) <= F.lit(threshold))) / F.size(v)


def quantize_binary(v: Column) -> Column:
    """1 where an element is above 0."""
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def rrf(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion: sum of 1 / (k + rank); a missing rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0))
    return out

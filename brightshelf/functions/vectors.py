"""Vector expressions on array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def l2_normalise(a: Column) -> Column:
    """Vector of length one; a zero vector is divided by 1e-8 and stays zero."""
    length = norm(a)
    divisor = F.when(length > 0, length).otherwise(F.lit(1e-8))
    return F.transform(_double(a), lambda x: x / divisor)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)

"""Vector expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DIMENSIONS = 1024


def truncated(v: Column, n: int = DIMENSIONS) -> Column:
    """The first n values, not rescaled."""
    return F.slice(v, 1, n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

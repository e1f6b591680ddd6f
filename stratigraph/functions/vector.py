"""Vector arithmetic on array<double> columns with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column, size: str | Column | None = None) -> Column:
    """x / (|x| + 1e-12); a zero vector stays zero. ``size``: a column that already holds the norm."""
    length = norm(a) if size is None else F.col(size) if isinstance(size, str) else size
    return F.transform(a, lambda v: v / (length + EPS))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)

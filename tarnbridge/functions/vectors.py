"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty, zero or unequally long vectors."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    size = norm(a) * norm(b)
    return F.when(usable & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def literal(vector: list[float], digits: int = 8) -> Column:
    """A vector as an array column, rounded as in its text form."""
    return F.array(*[F.lit(round(float(x), digits)) for x in vector])

"""Arithmetic on array columns, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column | str) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: (u.cast("double") - v.cast("double")) * (u.cast("double") - v.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def power(a: Column, zeta: float) -> Column:
    return F.transform(a, lambda v: F.pow(v.cast("double"), F.lit(float(zeta))))


def leading(a: Column, d: int) -> Column:
    """The first d components."""
    return F.slice(a, 1, d)


def axes(a: Column, *which: int) -> Column:
    """Components by 0-based position."""
    return F.array(*[F.get(a, F.lit(k)) for k in which])

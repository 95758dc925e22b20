"""Unit cells: an array of three row vectors, or lengths a, b, c with angles alpha, beta, gamma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from descmap.functions import vectors as V


def _row(h: Column, i: int) -> Column:
    return F.get(h, F.lit(i))


def _at(h: Column, i: int, j: int) -> Column:
    return F.get(_row(h, i), F.lit(j))


def volume(h: Column) -> Column:
    a = lambda i, j: _at(h, i, j)
    return F.abs(a(0, 0) * (a(1, 1) * a(2, 2) - a(1, 2) * a(2, 1)) - a(0, 1) * (a(1, 0) * a(2, 2) - a(1, 2) * a(2, 0)) + a(0, 2) * (a(1, 0) * a(2, 1) - a(1, 1) * a(2, 0)))


def lengths(h: Column) -> list[Column]:
    """a, b, c of any cell."""
    return [V.norm(_row(h, i)) for i in range(3)]


def angles(h: Column, degrees: bool = False) -> list[Column]:
    """alpha, beta, gamma of any cell."""
    n = lengths(h)
    out = [F.acos(V.dot(_row(h, i), _row(h, j)) / (n[i] * n[j])) for i, j in ((1, 2), (0, 2), (0, 1))]
    return [F.degrees(x) for x in out] if degrees else out


def from_lengths(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column, degrees: bool = False) -> Column:
    """Upper triangular cell with vectors in its columns: a along x, b in the plane of x and y."""
    if degrees:
        alpha, beta, gamma = (F.radians(x) for x in (alpha, beta, gamma))
    zero = F.lit(0.0)
    bx, by, cx = b * F.cos(gamma), b * F.sin(gamma), c * F.cos(beta)
    cy = (b * c * F.cos(alpha) - bx * cx) / by
    return F.array(F.array(a, bx, cx), F.array(zero, by, cy), F.array(zero, zero, F.sqrt(c * c - cx * cx - cy * cy)))


def minimum_image(s: Column) -> Column:
    """Fractional components moved by whole cells to the nearest image; halves go to the even side."""
    return F.transform(s, lambda v: v - F.rint(v))

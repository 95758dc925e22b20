"""Kernels between two vector columns, and what is made of kernel values.

A spec is {tag: {"type": "linear" | "polynomial" | "cosine", "d": degree}}; several kernels are summed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from descmap.functions import vectors as V

Spec = dict[str, dict]


def _degree(spec: dict) -> float:
    d = spec.get("d", spec.get("parameter", 2))
    return 2.0 if d is None else float(d)


_COLUMNS: dict[str, Callable[[dict, Column, Column], Column]] = {
    "linear": lambda s, a, b: V.dot(a, b),
    "polynomial": lambda s, a, b: F.pow(V.dot(a, b), F.lit(_degree(s))),
    "cosine": lambda s, a, b: V.cosine(a, b),
}


def kind(spec: dict) -> str:
    name = str(spec.get("type", "linear")).lower()
    if name not in _COLUMNS:
        raise ValueError(f"unknown kernel {name!r}; there are {sorted(_COLUMNS)}")
    return name


def column(spec: Spec, a: Column, b: Column) -> Column:
    """The sum of the listed kernels of two vector columns."""
    return reduce(lambda x, y: x + y, [_COLUMNS[kind(s)](s, a, b) for s in spec.values()])


def matrix(spec: Spec, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all rows of two matrices."""
    out = np.zeros((len(a), len(b)))
    for s in spec.values():
        name, k = kind(s), a @ b.T
        if name == "polynomial":
            k = k ** _degree(s)
        elif name == "cosine":
            n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
            k = np.divide(k, n, out=np.zeros_like(k), where=n > 0)
        out += k
    return out


def n_features(spec: Spec, d: int) -> int | None:
    """Length of `features` of vectors of d numbers; None if a kernel has none of finite length here (a degree that is no whole number)."""
    total = 0
    for s in spec.values():
        p = _degree(s) if kind(s) == "polynomial" else 1.0
        if p != int(p) or p < 0:
            return None
        total += math.comb(d + int(p) - 1, int(p))
    return total


def features(spec: Spec, a: np.ndarray) -> np.ndarray:
    """Rows whose dot products are the kernel: the vectors (of length one), monomials of a polynomial kernel's degree."""
    parts = []
    for s in spec.values():
        name = kind(s)
        if name == "cosine":
            n = np.linalg.norm(a, axis=1, keepdims=True)
            parts.append(np.divide(a, n, out=np.zeros_like(a), where=n > 0))
        elif name == "polynomial":
            cols = []
            for at in combinations_with_replacement(range(a.shape[1]), p := int(_degree(s))):
                many = math.factorial(p) / math.prod(math.factorial(at.count(k)) for k in set(at))
                cols.append(math.sqrt(many) * a[:, list(at)].prod(1))
            parts.append(np.stack(cols, 1))
        else:
            parts.append(a)
    return np.hstack(parts)


def normalised(k: Column, k_ii: Column, k_jj: Column) -> Column:
    """k / sqrt(k_ii k_jj), 1 at most."""
    return F.least(k / F.sqrt(k_ii * k_jj), F.lit(1.0))


def to_distance(k: Column) -> Column:
    """Distance in feature space of a normalised kernel: sqrt(2 - 2 k)."""
    return F.sqrt(F.greatest(2.0 - 2.0 * k, F.lit(0.0)))


def to_linear_distance(k: Column) -> Column:
    return F.greatest(1.0 - k, F.lit(0.0))


def rho_of_kernel(k, delta: float):
    """A pair's share of the density of a normalised kernel, to be summed by i; of a column or an array."""
    return _exp((k - 1.0) / delta)


def rho_of_distance(d, delta: float):
    return _exp(-d / delta)


def _exp(v):
    return np.exp(v) if isinstance(v, np.ndarray) else F.exp(v)

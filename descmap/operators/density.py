"""Kernel density estimates; all return logarithms of densities."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descmap.operators.blocks import Block, gram, nearest, pair_blocks, samples, squared_distances, tiles
from descmap.operators.sampling import draw


def _log_ball(d: int) -> float:
    """Logarithm of the unit ball's volume."""
    return 0.5 * d * math.log(math.pi) - math.lgamma(0.5 * d + 1)


def log_normaliser(kernel: str, h: float, d: int) -> float:
    """What is subtracted from the log of a mean of kernel values, so that the density integrates to one."""
    if kernel == "gaussian":
        return 0.5 * d * math.log(2 * math.pi) + d * math.log(h)
    shell = _log_ball(d) + math.log(d)  # surface of the unit ball
    if kernel == "tophat":
        inner = -math.log(d)
    elif kernel == "epanechnikov":
        inner = math.log(2) - math.log(d) - math.log(d + 2)
    elif kernel == "exponential":
        inner = math.lgamma(d)
    elif kernel == "linear":
        inner = -math.log(d) - math.log(d + 1)
    elif kernel == "cosine":
        t = np.linspace(0, 1, 20001)
        inner = math.log(float(np.trapezoid(t ** (d - 1) * np.cos(np.pi * t / 2), t)))
    else:
        raise ValueError(f"unknown kernel {kernel!r}")
    return shell + inner + d * math.log(h)


def _log_kernel(kernel: str, t: np.ndarray) -> np.ndarray:
    """Of the distance in bandwidths."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if kernel == "gaussian":
            return -0.5 * t * t
        if kernel == "exponential":
            return -t
        inner = {"tophat": lambda: np.zeros_like(t), "epanechnikov": lambda: np.log(1 - np.minimum(t, 1) ** 2), "linear": lambda: np.log(1 - np.minimum(t, 1)), "cosine": lambda: np.log(np.cos(0.5 * np.pi * np.minimum(t, 1)))}[kernel]()
    return np.where(t < 1, inner, -np.inf)


def _log_sums(at: DataFrame, points: DataFrame, fn, reach: float | None = None) -> DataFrame:
    """id, log: logarithm of the sum over points of exp(fn(vectors of `at`, vectors of points)); reach: the distance from which on kernels are zero."""

    def run(a: Block, b: Block) -> pa.Table:
        m, s = np.full(len(a.ids), -np.inf), np.zeros(len(a.ids))
        for i, j in tiles(a, b):
            v = fn(a.x[i], b.x[j])
            top = np.maximum(m[i], v.max(1))
            safe = np.where(np.isfinite(top), top, 0.0)
            v -= safe[:, None]
            s[i] = s[i] * np.exp(m[i] - safe) + np.exp(v, out=v).sum(1)
            m[i] = top
        return pa.table({"id": a.ids, "m": np.where(np.isfinite(m), m, 0.0), "s": s})

    some = pair_blocks(at, points, run, "id bigint, m double, s double", reach=reach)
    top = some.groupBy("id").agg(F.max(F.when(F.col("s") > 0, F.col("m"))).alias("top"), F.collect_list(F.struct("m", "s")).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda t, p: t + p["s"] * F.exp(p["m"] - F.col("top")))
    found = top.select("id", (F.col("top") + F.log(total)).alias("log"))
    found = found if reach is None else at.select("id").join(found, "id", "left")
    return found.select("id", F.coalesce("log", F.lit(float("-inf"))).alias("log"))


def kde(df: DataFrame, bandwidth: float = 1.0, kernel: str = "gaussian", at: DataFrame | None = None, id_col: str = "sample_id", x_col: str = "x") -> DataFrame:
    """id and log_density of the rows of `at` (else of df) under kernels around all rows of df; -inf where all kernels are zero."""
    points = samples(df, id_col, x_col)
    n, d = points.count(), points.select(F.max(F.size("x"))).first()[0]
    rows = points if at is None else samples(at, id_col, x_col)
    if kernel == "gaussian":
        fn = lambda a, b: squared_distances(a, b) * (-0.5 / bandwidth**2)
    else:
        fn = lambda a, b: _log_kernel(kernel, np.sqrt(squared_distances(a, b)) / bandwidth)
    logs = _log_sums(rows, points, fn, None if kernel in ("gaussian", "exponential") else bandwidth)
    return logs.select(F.col("id").alias(id_col), (F.col("log") - math.log(n) - log_normaliser(kernel, bandwidth, d)).alias("log_density"))


def kde_full(df: DataFrame, method: str | float = "scott", at: DataFrame | None = None, id_col: str = "sample_id", x_col: str = "x") -> DataFrame:
    """Gaussian kernels with the data's whole covariance times a squared factor: scott, silverman, or a number."""
    points = samples(df, id_col, x_col)
    m = gram(points)
    n, d = m.n, len(m.total)
    factor = n ** (-1 / (d + 4)) if method == "scott" else (n * (d + 2) / 4) ** (-1 / (d + 4)) if method == "silverman" else float(method)
    cov = m.covariance * n / (n - 1) * factor * factor
    inv = np.linalg.cholesky(np.linalg.inv(cov))
    norm = 0.5 * (d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1])
    rows = points if at is None else samples(at, id_col, x_col)
    logs = _log_sums(rows, points, lambda a, b: -0.5 * squared_distances(a @ inv, b @ inv))
    return logs.select(F.col("id").alias(id_col), (F.col("log") - math.log(n) - norm).alias("log_density"))


def round_float(v: float) -> float:
    """A number's first digit other than zero becomes 1, what follows is dropped."""
    return 0.0 if v == 0 else math.copysign(10.0 ** math.floor(math.log10(abs(v))) if abs(v) < 1 else 1.0, v)


def bounded_minimum(fn, low: float, high: float, tolerance: float, most: int = 100) -> tuple[float, float, int]:
    """(place, value, evaluations) of a minimum between low and high, by golden sections."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd, n = fn(c), fn(d), 2
    while b - a > tolerance and n < most:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = fn(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = fn(d)
        n += 1
    return (c, fc, n) if fc < fd else (d, fd, n)


class BestBandwidth:
    """KDE whose bandwidth gives a held-out tenth (by hash of id) the largest likelihood."""

    def __init__(self, kernel: str = "gaussian", test_share: float = 0.1, bandwidth: float | None = None, most: int = 100):
        self.kernel, self.test_share, self.bandwidth, self.most = kernel, test_share, bandwidth, most

    def fit(self, df: DataFrame, id_col: str = "sample_id", x_col: str = "x") -> BestBandwidth:
        self.df, self.id_col, self.x_col = df, id_col, x_col
        if self.bandwidth is not None:
            return self
        rows = samples(df, id_col, x_col)
        test = rows.where(draw("id", "kde") < self.test_share)
        train = rows.where(draw("id", "kde") >= self.test_share)
        d = rows.select(F.max(F.size("x"))).first()[0]
        second = nearest(test, train, 2).where("rank = 1").agg(F.avg(F.col("distance") ** 2)).first()[0]
        low = math.sqrt(second / d)
        # mean squared distance of two independent rows: twice the trace of the covariance
        high = 0.2 * math.sqrt(2 * np.trace(gram(rows).covariance) / d)

        def cost(h: float) -> float:
            return -kde(train, h, self.kernel, test, "id", "x").agg(F.avg("log_density")).first()[0]

        self.bandwidth, self.score, self.evaluations = bounded_minimum(cost, low, max(high, 1.01 * low), round_float(low), self.most)
        return self

    def evaluate(self, at: DataFrame | None = None) -> DataFrame:
        return kde(self.df, self.bandwidth, self.kernel, at, self.id_col, self.x_col)

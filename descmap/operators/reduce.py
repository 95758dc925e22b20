"""Dimension reduction: column scaling, whitened PCA, kernel PCA and its sparse form, UMAP, t-SNE, and pipelines of them.

A reducer has fit(df) and transform(df, out); models are small arrays on the driver that go to the executors with
the projecting tasks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descmap.functions import kernels
from descmap.operators.blocks import gram, local, map_matrix, nearest, samples
from descmap.operators.sampling import landmarks


@dataclass
class Scale:
    """z-scores with the population's standard deviation; constant columns are only centred."""

    mean: np.ndarray | None = None
    std: np.ndarray | None = None
    on: bool = True

    def fit(self, df: DataFrame, x_col: str = "x") -> Scale:
        m = gram(df, x_col)
        self.mean = m.mean if self.on else np.zeros_like(m.mean)
        std = np.sqrt(np.maximum(np.diag(m.covariance), 0))
        self.std = np.where(std > 1e-12, std, 1.0) if self.on else np.ones_like(std)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std

    def transform(self, df: DataFrame, x_col: str = "x", out: str = "z") -> DataFrame:
        return map_matrix(df, x_col, out, self.apply)


@dataclass
class PCA:
    """Components of the covariance (n - 1 in the denominator), largest first, each divided by its standard deviation.

    scale: z-score the columns first; otherwise they are centred for the fit alone.
    """

    k: int = 10
    scale: bool = True
    scaler: Scale | None = None
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None

    def fit(self, df: DataFrame, x_col: str = "x") -> PCA:
        if self.vectors is not None:
            raise RuntimeError("fitted already")
        m = gram(df, x_col)
        self.scaler = Scale(on=self.scale)
        std = np.sqrt(np.maximum(np.diag(m.covariance), 0))
        self.scaler.mean, self.scaler.std = (m.mean, np.where(std > 1e-12, std, 1.0)) if self.scale else (np.zeros_like(m.mean), np.ones_like(std))
        cov = m.covariance / np.outer(self.scaler.std, self.scaler.std) * m.n / max(1, m.n - 1)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[: self.k]
        self.values = np.maximum(values[order], 1e-300)
        v = vectors[:, order]
        # the largest entry of each component is positive, so that results don't depend on the solver
        self.vectors = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.scaler.apply(x) @ self.vectors / np.sqrt(self.values)

    def transform(self, df: DataFrame, x_col: str = "x", out: str = "pca") -> DataFrame:
        return map_matrix(df, x_col, out, self.apply)


@dataclass
class KernelPCA:
    """Kernel PCA on a precomputed square kernel."""

    k: int = 4
    colmean: np.ndarray | None = None
    mean: float = 0.0
    values: np.ndarray | None = None
    alphas: np.ndarray | None = None

    def fit(self, kernel: np.ndarray) -> KernelPCA:
        if self.alphas is not None:
            raise RuntimeError("fitted already")
        if kernel.shape[0] != kernel.shape[1] or np.abs(kernel - kernel.T).max(initial=0) > 1e-6 * max(1.0, np.abs(kernel).max(initial=0)):
            raise ValueError("the kernel must be square and symmetric")
        self.colmean = kernel.mean(1)
        self.mean = float(self.colmean.mean())
        values, vectors = np.linalg.eigh(kernel - self.colmean[None, :] - self.colmean[:, None] + self.mean)
        order = np.argsort(-values, kind="stable")[: self.k]
        self.values = np.maximum(values[order], 1e-300)
        v = vectors[:, order]
        self.alphas = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]) / np.sqrt(self.values)
        return self

    def apply(self, kernel: np.ndarray) -> np.ndarray:
        """Projections of rows given by their kernel with the fitted rows."""
        return (kernel + self.mean - self.colmean[None, :] - kernel.mean(1)[:, None]) @ self.alphas


@dataclass
class SparseKernelPCA:
    """Kernel PCA of landmarks; all other rows are projected by their kernel with them."""

    k: int = 10
    n_sparse: int | None = None
    mode: str = "fps"
    kernel: dict = field(default_factory=lambda: {"k0": {"type": "linear"}})
    x: np.ndarray | None = None
    model: KernelPCA | None = None

    def fit(self, df: DataFrame, x_col: str = "x", id_col: str = "sample_id") -> SparseKernelPCA:
        _, self.x = landmarks(df, self.mode, self.n_sparse, id_col, x_col)
        self.model = KernelPCA(self.k).fit(kernels.matrix(self.kernel, self.x, self.x))
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.model.apply(kernels.matrix(self.kernel, x, self.x))

    def transform(self, df: DataFrame, x_col: str = "x", out: str = "skpca") -> DataFrame:
        return map_matrix(df, x_col, out, self.apply)


def _affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Row-wise probabilities of the given perplexity, by bisection."""
    p = np.zeros_like(d2)
    for i, row in enumerate(d2):
        lo, hi, beta = 0.0, np.inf, 1.0
        other = np.delete(row, i)
        for _ in range(60):
            w = np.exp(-(other - other.min()) * beta)
            w /= w.sum()
            h = -(w * np.log(np.maximum(w, 1e-300))).sum()
            if abs(h - np.log(perplexity)) < 1e-5:
                break
            lo, hi = (beta, hi) if h > np.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(len(row)) != i] = w
    return p


def t_sne(x: np.ndarray, d: int = 2, perplexity: float = 30.0, exaggeration: float = 12.0, rate: float = 200.0, steps: int = 500, seed: int = 0) -> np.ndarray:
    """Exact t-SNE of a bounded set of rows."""
    n = len(x)
    d2 = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0)
    p = _affinities(d2, min(perplexity, max(1.0, (n - 1) / 3)))
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, d))
    v, gain = np.zeros_like(y), np.ones_like(y)
    for step in range(steps):
        q = 1 / (1 + np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        w = (p * (exaggeration if step < 250 else 1) - q / q.sum()) * q
        g = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(g) == np.sign(v), gain * 0.8, gain + 0.2), 0.01)
        v = (0.5 if step < 250 else 0.8) * v - rate * gain * g
        y = y + v
        y -= y.mean(0)
    return y


@dataclass
class TSNE:
    """t-SNE in two (or d) dimensions after a PCA to 50; `most` rows at most, since its layout is one array. It has no transform for other rows."""

    d: int = 2
    perplexity: float = 30.0
    exaggeration: float = 12.0
    rate: float = 200.0
    steps: int = 500
    pca: bool = True
    most: int = 20_000

    def fit_transform(self, df: DataFrame, x_col: str = "x", id_col: str = "sample_id", out: str = "tsne") -> DataFrame:
        if df.count() > self.most:
            raise ValueError(f"t-SNE lays out {self.most} rows at most; sparsify first")
        ids, x = local(samples(df, id_col, x_col))
        if self.pca and x.shape[1] > 50:
            c = x - x.mean(0)
            x = c @ np.linalg.svd(c, full_matrices=False)[2][:50].T
        y = t_sne(x, self.d, self.perplexity, self.exaggeration, self.rate, self.steps)
        return _joined(df, ids, y, id_col, out)

    def transform(self, *_):
        raise NotImplementedError("t-SNE has no projection of other rows")


def _joined(df: DataFrame, ids: np.ndarray, y: np.ndarray, id_col: str, out: str) -> DataFrame:
    made = df.sparkSession.createDataFrame(list(zip(ids.tolist(), y.tolist(), strict=True)), f"`{id_col}` bigint, `{out}` array<double>")
    return df.join(made, id_col)


@dataclass
class UMAP:
    """Neighbour graph in Spark, layout by gradient steps on the driver for `most` rows at most; other rows go to the mean of their neighbours."""

    d: int = 2
    n_neighbors: int = 10
    min_dist: float = 0.1
    epochs: int = 200
    most: int = 100_000
    seed: int = 0
    x: np.ndarray | None = None
    y: np.ndarray | None = None

    def fit_transform(self, df: DataFrame, x_col: str = "x", id_col: str = "sample_id", out: str = "umap") -> DataFrame:
        if df.count() > self.most:
            raise ValueError(f"the layout takes {self.most} rows at most; sparsify first")
        rows = samples(df, id_col, x_col)
        ids, self.x = local(rows)
        k = min(self.n_neighbors, len(ids))
        got = nearest(rows, rows, k).orderBy("id", "rank").toArrow()
        at = np.searchsorted(ids, got.column("id").to_numpy()), np.searchsorted(ids, got.column("other").to_numpy())
        dist = got.column("distance").to_numpy().reshape(len(ids), k)
        rho = dist[:, 1] if k > 1 else dist[:, 0]
        sigma = np.array([self._sigma(r[1:], p, k) for r, p in zip(dist, rho, strict=True)])
        w = np.exp(-np.maximum(dist - rho[:, None], 0) / sigma[:, None])
        a, b = at[0][at[0] != at[1]], at[1][at[0] != at[1]]
        w = w.ravel()[at[0] != at[1]]
        table: dict[tuple[int, int], float] = {}
        for i, j, v in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            table[i, j] = v
        edges = [(i, j, v + table.get((j, i), 0.0) - v * table.get((j, i), 0.0)) for (i, j), v in table.items()]
        self.y = self._layout(len(ids), np.array([e[:2] for e in edges]).reshape(-1, 2), np.array([e[2] for e in edges]))
        return _joined(df, ids, self.y, id_col, out)

    @staticmethod
    def _sigma(d: np.ndarray, rho: float, k: int) -> float:
        lo, hi, s = 0.0, np.inf, 1.0
        for _ in range(64):
            total = np.exp(-np.maximum(d - rho, 0) / s).sum()
            if abs(total - np.log2(max(2, k))) < 1e-5:
                break
            lo, hi = (lo, s) if total > np.log2(max(2, k)) else (s, hi)
            s = s * 2 if hi == np.inf else (lo + hi) / 2
        return max(s, 1e-3)

    def _layout(self, n: int, edges: np.ndarray, weight: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        c = self.x - self.x.mean(0)
        y = c @ np.linalg.svd(c, full_matrices=False)[2][: self.d].T if c.shape[1] >= self.d else rng.normal(size=(n, self.d))
        y = 10 * y / max(1e-12, np.abs(y).max()) + rng.normal(0, 1e-4, (n, self.d))
        # a, b of 1 / (1 + a d^2b), fitted to the curve that is 1 up to min_dist and decays beyond it
        t = np.linspace(0.01, 3, 300)
        want = np.where(t < self.min_dist, 1, np.exp(-(t - self.min_dist)))
        fits = [(np.abs(1 / (1 + a * t ** (2 * b)) - want).sum(), a, b) for a in np.linspace(0.3, 3, 28) for b in np.linspace(0.4, 1.6, 25)]
        _, a, b = min(fits)
        if not len(edges):
            return y
        for epoch in range(self.epochs):
            alpha = 1 - epoch / self.epochs
            use = rng.random(len(weight)) < weight / weight.max()
            i, j = edges[use, 0], edges[use, 1]
            diff = y[i] - y[j]
            d2 = np.maximum((diff * diff).sum(1), 1e-12)
            g = np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * diff, -4, 4)
            np.add.at(y, i, alpha * g)
            np.add.at(y, j, -alpha * g)
            for _ in range(5):
                other = rng.integers(0, n, len(i))
                diff = y[i] - y[other]
                d2 = (diff * diff).sum(1)
                g = np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * diff, -4, 4)
                np.add.at(y, i, np.where((i != other)[:, None], alpha * g, 0))
        return y

    def apply(self, x: np.ndarray) -> np.ndarray:
        d2 = np.maximum((x * x).sum(1)[:, None] + (self.x * self.x).sum(1)[None, :] - 2 * x @ self.x.T, 0)
        near = np.argsort(d2, axis=1)[:, : self.n_neighbors]
        w = 1 / np.maximum(np.sqrt(np.take_along_axis(d2, near, 1)), 1e-9)
        return (self.y[near] * (w / w.sum(1, keepdims=True))[:, :, None]).sum(1)

    def transform(self, df: DataFrame, x_col: str = "x", out: str = "umap") -> DataFrame:
        return map_matrix(df, x_col, out, self.apply)


class Pipeline:
    """Reducers in the order of a spec {tag: {"type": SCALE | PCA | SPARSE_KPCA | UMAP | TSNE | RAW, "parameter": {...}}}; each takes what the one before made."""

    def __init__(self, spec: dict):
        self.spec, self.stages = spec, []

    @staticmethod
    def _make(spec: dict):
        p = spec.get("parameter") or {}
        kind = spec["type"].upper()
        if kind == "SCALE":
            return Scale()
        if kind == "PCA":
            return PCA(p.get("n_components", 10), p.get("scalecenter", True))
        if kind in ("SPARSE_KPCA", "SKPCA"):
            return SparseKernelPCA(p.get("n_components", 10), p.get("n_sparse"), p.get("sparse_mode", "fps"), p.get("kernel", {"k0": {"type": "linear"}}))
        if kind == "UMAP":
            return UMAP(p.get("n_components", 2), p.get("n_neighbors", 10), p.get("min_dist", 0.1))
        if kind == "TSNE":
            return TSNE(p.get("n_components", 2), p.get("perplexity", 30.0), p.get("early_exaggeration", 12.0), p.get("learning_rate", 200.0))
        if kind == "RAW":
            return None
        raise ValueError(f"unknown reducer {kind!r}")

    def fit_transform(self, df: DataFrame, x_col: str = "x", id_col: str = "sample_id", out: str = "reduced") -> DataFrame:
        now = df.withColumn(out, F.col(x_col))
        for spec in self.spec.values():
            stage = self._make(spec)
            if stage is None:
                continue
            if isinstance(stage, (UMAP, TSNE)):
                made = stage.fit_transform(now, out, id_col, "_made")
            else:
                made = (stage.fit(now, out, id_col) if isinstance(stage, SparseKernelPCA) else stage.fit(now, out)).transform(now, out, "_made")
            self.stages.append(stage)
            now = made.drop(out).withColumnRenamed("_made", out)
        return now

    def transform(self, df: DataFrame, x_col: str = "x", out: str = "reduced") -> DataFrame:
        now = df.withColumn(out, F.col(x_col))
        for stage in self.stages:
            now = stage.transform(now, out, "_made").drop(out).withColumnRenamed("_made", out)
        return now

    def state(self) -> str:
        return json.dumps(self.spec)

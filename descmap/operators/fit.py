"""Regression: error metrics, ridge, kernel ridge (full, sparse, cross-validated), learning curves, the design matrix."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from descmap.functions import kernels
from descmap.operators.blocks import gram, local, map_matrix, to_matrix
from descmap.operators.graph import counted
from descmap.operators.reduce import Scale
from descmap.operators.sampling import draw, exponential_split, landmarks, random_split, sparsify


#: Features of a kernel at most: their products are one matrix on the driver.
WIDE = 4096


def _ranks(df: DataFrame, col: str) -> DataFrame:
    """Each different value with its average rank: counts of values meet, not rows."""
    return counted(df, col).select(col, (F.col("_before") + (F.col("n") + 1) / 2).alias(f"rank_{col}"))


def metrics(df: DataFrame, y: str = "y", y_pred: str = "y_pred", ranked: bool = True) -> DataFrame:
    """One row with MAE, RMSE, SUP, R2, CORR and SPEARMAN (average ranks) over rows with both values."""
    rows = df.where(F.col(y).isNotNull() & F.col(y_pred).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(y_pred).cast("double").alias("p"))
    e = F.col("p") - F.col("y")
    one = rows.agg(
        F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.max(F.abs(e)).alias("SUP"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count("y"))).alias("R2"), F.corr("y", "p").alias("CORR")
    )
    if not ranked:
        return one
    both = rows.join(_ranks(rows, "y"), "y").join(_ranks(rows, "p"), "p")
    return one.join(F.broadcast(both.agg(F.corr("rank_y", "rank_p").alias("SPEARMAN"))), how="cross")


@dataclass
class Ridge:
    """Linear weights with an l2 penalty on all of them (a bias column, if there is one, too)."""

    sigma: float = 1e-4
    weights: np.ndarray | None = None

    def fit(self, df: DataFrame, x_col: str = "x", y_col: str = "y") -> Ridge:
        rows = df.where(F.col(y_col).isNotNull()).select(F.concat(F.col(x_col).cast("array<double>"), F.array(F.col(y_col).cast("double"))).alias("x"))
        self.weights = self.solved(gram(rows).outer)
        return self

    def solved(self, c: np.ndarray) -> np.ndarray:
        """Weights from the outer products of columns and target."""
        d = len(c) - 1
        return np.linalg.solve(c[:d, :d] + self.sigma * np.eye(d), c[:d, d])

    def predict(self, df: DataFrame, x_col: str = "x", out: str = "y_pred") -> DataFrame:
        w = self.weights
        return map_matrix(df, x_col, out, lambda x: x @ w, scalar=True)


@dataclass
class KernelRidge:
    """Full kernel ridge. Up to `most` rows their kernel is held in one place. More rows are fitted by the kernel's features (`kernels.features`,
    WIDE at most): with K = F F', K (K + s)^-1 y = F (F'F + s)^-1 F'y, and F'F is summed by the tasks that read the rows."""

    sigma: float = 1e-4
    kernel: dict = field(default_factory=lambda: {"k0": {"type": "linear"}})
    delta: float = 1.0
    x: np.ndarray | None = None
    alpha: np.ndarray | None = None
    weights: np.ndarray | None = None

    def fit(self, df: DataFrame, x_col: str = "x", y_col: str = "y", id_col: str = "sample_id", most: int = 10_000) -> KernelRidge:
        rows = df.where(F.col(y_col).isNotNull())
        self.x = self.alpha = self.weights = None
        if df.count() > most:
            return self._fit_features(rows, x_col, y_col, most)
        _, both = local(rows.select(F.col(id_col).alias("id"), F.concat(F.col(x_col).cast("array<double>"), F.array(F.col(y_col).cast("double"))).alias("x")))
        self.x, self.y = both[:, :-1], both[:, -1]
        self.c = kernels.matrix(self.kernel, self.x, self.x) + self.sigma * np.eye(len(self.x))
        self.alpha = np.linalg.solve(self.c, self.y)
        return self

    def predict(self, df: DataFrame, x_col: str = "x", out: str = "y_pred") -> DataFrame:
        x, a, spec, w = self.x, self.alpha, self.kernel, self.weights
        if w is not None:
            return map_matrix(df, x_col, out, lambda v: kernels.features(spec, v) @ w, scalar=True)
        return map_matrix(df, x_col, out, lambda v: kernels.matrix(spec, v, x) @ a, scalar=True)

    def _fit_features(self, rows: DataFrame, x_col: str, y_col: str, most: int) -> KernelRidge:
        width = kernels.n_features(self.kernel, rows.select(F.max(F.size(x_col))).first()[0])
        if width is None or width > WIDE:
            raise ValueError(f"full kernel ridge on more than {most} rows takes kernels of {WIDE} features at most; use the sparse form")
        spec = self.kernel
        both = rows.select(F.concat(F.col(x_col).cast("array<double>"), F.array(F.col(y_col).cast("double"))).alias("x"))
        c = gram(both, "x", lambda v: np.hstack([kernels.features(spec, v[:, :-1]), v[:, -1:]])).outer
        self.inverse = np.linalg.inv(c[:-1, :-1] + self.sigma * np.eye(width))
        self.weights = np.linalg.solve(c[:-1, :-1] + self.sigma * np.eye(width), c[:-1, -1])
        return self

    def left_out(self, df: DataFrame, x_col: str = "x", y_col: str = "y", out: str = "y_pred") -> DataFrame:
        """df, the fitted rows, with each row's prediction from all others, without fitting again; rows without a target have none."""
        if self.weights is None:
            x, spec, alpha, inv, sigma = self.x, self.kernel, self.alpha, np.linalg.solve(self.c, np.eye(len(self.c))), self.sigma

            def fn(v: np.ndarray) -> np.ndarray:
                # a fitted row's own column k of the kernel gives its share h of its own prediction: k' C^-1 k = k(v, v) - s h
                k = kernels.matrix(spec, v[:, :-1], x)
                own = np.array([kernels.matrix(spec, u[None, :-1], u[None, :-1])[0, 0] for u in v])
                h = (own - np.einsum("ij,ij->i", k @ inv, k)) / sigma
                return v[:, -1] - (v[:, -1] - k @ alpha) / (1 - h)
        else:
            w, inv, spec = self.weights, self.inverse, self.kernel

            def fn(v: np.ndarray) -> np.ndarray:
                f = kernels.features(spec, v[:, :-1])
                h = np.einsum("ij,ij->i", f @ inv, f)
                return v[:, -1] - (v[:, -1] - f @ w) / (1 - h)

        given = df.withColumn("_xy", F.when(F.col(y_col).isNotNull(), F.concat(F.col(x_col).cast("array<double>"), F.array(F.col(y_col).cast("double")))))
        return map_matrix(given, "_xy", out, fn, scalar=True).drop("_xy")

    def uncertainty(self, df: DataFrame, x_col: str = "x", out: str = "y_std") -> DataFrame:
        """sqrt(delta (1 - k' C^-1 k)), for kernels that are 1 on the diagonal."""
        if self.weights is not None:
            spec, delta, inverse, sigma = self.kernel, self.delta, self.inverse, self.sigma

            def by_features(v: np.ndarray) -> np.ndarray:
                # k' C^-1 k = f'f - s f' (F'F + s)^-1 f
                f = kernels.features(spec, v)
                return np.sqrt(np.maximum(delta * (1 - (f * f).sum(1) + sigma * np.einsum("ij,ij->i", f @ inverse, f)), 0))

            return map_matrix(df, x_col, out, by_features, scalar=True)
        x, inv, spec, delta = self.x, np.linalg.solve(self.c, np.eye(len(self.c))), self.kernel, self.delta

        def fn(v: np.ndarray) -> np.ndarray:
            k = kernels.matrix(spec, v, x)
            return np.sqrt(np.maximum(delta * (1 - np.einsum("ij,jk,ik->i", k, inv, k)), 0))

        return map_matrix(df, x_col, out, fn, scalar=True)

    def cross_validated(self, folds: list[np.ndarray]) -> np.ndarray:
        """Predictions of every fitted row from the rows of other folds, without fitting again (for rows held in one place; see `left_out`)."""
        if self.alpha is None:
            raise ValueError("the rows are not held in one place")
        inv = np.linalg.solve(self.c, np.eye(len(self.c)))
        out = np.empty(len(self.y))
        for f in folds:
            out[f] = self.y[f] - np.linalg.solve(inv[np.ix_(f, f)], self.alpha[f])
        return out


@dataclass
class SparseKernelRidge:
    """Kernel ridge on landmarks: sums over all rows are M x M, made by the tasks that read the rows."""

    sigma: float | None = None
    jitter: float = 1e-20
    n_sparse: int | None = None
    mode: str = "fps"
    kernel: dict = field(default_factory=lambda: {"k0": {"type": "linear"}})
    delta: float | None = None
    x: np.ndarray | None = None
    alpha: np.ndarray | None = None

    def fit(self, df: DataFrame, x_col: str = "x", y_col: str = "y", id_col: str = "sample_id") -> SparseKernelRidge:
        rows = df.where(F.col(y_col).isNotNull())
        _, self.x = landmarks(rows, self.mode, self.n_sparse, id_col, x_col)
        kmm = kernels.matrix(self.kernel, self.x, self.x)
        std = rows.agg(F.stddev_pop(F.col(y_col).cast("double"))).first()[0]
        self.delta = std / (np.trace(kmm) / len(kmm)) if self.delta is None else self.delta
        self.sigma = 0.001 * std if self.sigma is None else self.sigma
        x, spec = self.x, self.kernel
        both = rows.select(F.concat(F.col(x_col).cast("array<double>"), F.array(F.col(y_col).cast("double"))).alias("x"))
        c = gram(both, "x", lambda v: np.hstack([kernels.matrix(spec, v[:, :-1], x), v[:, -1:]])).outer
        m = len(kmm)
        a = kmm * self.delta * self.sigma**2 + c[:m, :m] * self.delta**2 + self.jitter * np.eye(m)
        try:
            self.alpha = np.linalg.solve(a, c[:m, m])
        except np.linalg.LinAlgError:
            self.alpha = np.linalg.lstsq(a, c[:m, m], rcond=None)[0]
        return self

    def predict(self, df: DataFrame, x_col: str = "x", out: str = "y_pred") -> DataFrame:
        x, a, spec = self.x, self.alpha * self.delta**2, self.kernel
        return map_matrix(df, x_col, out, lambda v: kernels.matrix(spec, v, x) @ a, scalar=True)


class DesignMatrix:
    """Samples with a target: columns are whitened over all rows and a bias column is added, then rows are split by hash of id."""

    def __init__(self, df: DataFrame, whiten: bool = True, test_ratio: float = 0.0, seed: int = 42, id_col: str = "sample_id", x_col: str = "x", y_col: str = "y"):
        self.id_col, self.y_col, self.seed, self.results = id_col, y_col, seed, {}
        rows = df.select(F.col(id_col), F.col(x_col).cast("array<double>").alias("x"), F.col(y_col).cast("double").alias(y_col))
        split = random_split(rows, test_ratio, id_col, seed)
        # rows as given, with what makes columns of the design matrix of them
        made: Callable[[np.ndarray], np.ndarray] | None = None
        if whiten:
            scale = Scale().fit(rows)
            made = lambda x: np.hstack([scale.apply(x), np.ones((len(x), 1))])
            rows = map_matrix(rows, "x", "z", made).select(id_col, F.col("z").alias("x"), y_col)
        self._train, self._test = (split.where(~F.col("is_test")), made), (split.where("is_test"), made)
        self.all = random_split(rows, test_ratio, id_col, seed)
        self.train, self.test = self.all.where(~F.col("is_test")), self.all.where("is_test")

    def sparsify(self, n: float, mode: str = "fps") -> DataFrame:
        self.train = sparsify(self.train, mode, n, self.id_col, "x")
        self._train = self.train, None
        return self.train

    def compute_fit(self, learner, tag: str = "fit") -> dict:
        learner.fit(self.train, "x", self.y_col)
        out = {"train": metrics(learner.predict(self.train), self.y_col).first().asDict()}
        if self.test.limit(1).count():
            out["test"] = metrics(learner.predict(self.test), self.y_col).first().asDict()
        self.results[tag] = out
        return out

    def learning_curve(self, learner, points: int = 8, repeats: int = 8, tag: str = "lc") -> list[dict]:
        """Mean and standard deviation (population) of each score on the test rows, by size of the training set."""
        ids = self._train[0].select(self.id_col)
        tallies = _tallies(ids, self.id_col, [f"{self.seed}.{r}" for r in range(repeats)])
        n = int(tallies[0].sum()) if repeats else ids.count()
        low = min(n, max(20, n // 1000))
        sizes = sorted(set(exponential_split(low, n, points)))
        runs = [(size, r) for size in sizes for r in range(repeats if size < n else 1)]
        if isinstance(learner, Ridge):
            models = self._ridges(learner, runs, tallies)
            learner.weights = models[-1]
            scores = [{"size": size} | m for (size, _), m in zip(runs, self._scores(models), strict=True)]
        else:
            scores = []
            for size, r in runs:
                chosen = self.train.orderBy(draw(self.id_col, f"{self.seed}.{r}"), self.id_col).limit(size) if size < n else self.train
                learner.fit(chosen, "x", self.y_col)
                scores.append({"size": size} | metrics(learner.predict(self.test), self.y_col, ranked=False).first().asDict())
        out = learning_curve_stats(scores)
        self.results[tag] = out
        return out

    def _ridges(self, learner: Ridge, runs: list[tuple[int, int]], tallies: list[np.ndarray]) -> list[np.ndarray]:
        """Weights of every run from one pass. Products are summed by the first size that takes in a row, and sizes add up; rows of
        the ranges of a draw in which a size ends come to the driver, which orders them by draw, id and values."""
        rows, made = self._train
        ends = [np.cumsum(t) for t in tallies]
        steps = sorted({size for size, _ in runs})
        last = [np.searchsorted(e, steps) for e in ends]  # of each repeat: the range in which each size ends

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                use = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False))
                if not len(use):
                    continue
                x = to_matrix(b.column(0).take(pa.array(use)))
                x = np.hstack([x if made is None else made(x), b.column(1).to_numpy(zero_copy_only=False)[use, None]])
                for r in range(len(last)):
                    d = b.column(3 + r).to_numpy(zero_copy_only=False)[use]
                    place = np.floor(d * _RANGES).astype(int)
                    level = np.searchsorted(last[r], place)
                    edge = np.isin(place, last[r])
                    for k in np.unique(level[~edge]).tolist():
                        own = x[(level == k) & ~edge]
                        sums[r, k] = sums.get((r, k), 0) + own.T @ own
                    if edge.any():
                        at = np.flatnonzero(edge)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r)), pa.array(np.full(len(at), -1)), pa.array(list(x[at])), pa.array(d[at]), b.column(2).take(pa.array(use[at]))], schema=kinds)
            if sums:
                keys, none = list(sums), [None] * len(sums)
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in keys]), pa.array([k for _, k in keys]), pa.array([sums[k].ravel() for k in keys]), pa.array(none, pa.float64()), pa.array(none, kinds.field("i").type)], schema=kinds)

        given = rows.select("x", self.y_col, self.id_col, *[draw(self.id_col, f"{self.seed}.{r}").alias(f"_d{r}") for r in range(len(last))])
        kinds = pa.schema([("r", pa.int64()), ("k", pa.int64()), ("c", pa.list_(pa.float64())), ("d", pa.float64()), ("i", to_arrow_type(given.schema[self.id_col].dataType))])
        sums: dict[tuple[int, int], np.ndarray] = {}
        edges: list[list] = [[] for _ in last]
        for g in given.mapInArrow(part, f"r bigint, k bigint, c array<double>, d double, i {given.schema[self.id_col].dataType.simpleString()}").collect():
            if g.k < 0:
                edges[g.r].append((g.d, g.i, g.c))
            else:
                sums[g.r, g.k] = sums.get((g.r, g.k), 0) + np.array(g.c)
        width = next((round(len(c) ** 0.5) for c in sums.values()), None) or next((len(e[0][2]) for e in edges if e), None)
        if width is None:
            raise ValueError("no rows")
        out = []
        for e in edges:
            e.sort()
        for size, r in runs:
            s = steps.index(size)
            c = sum((sums[r, k] for k in range(s + 1) if (r, k) in sums), np.zeros(width * width)).reshape(width, width)
            # rows of ranges before the last one, and of that one as many as are left
            own = [v for v in edges[r] if int(v[0] * _RANGES) < last[r][s]]
            rest = [v for v in edges[r] if int(v[0] * _RANGES) == last[r][s]]
            before = int(ends[r][last[r][s] - 1]) if last[r][s] else 0
            x = np.array([v[2] for v in own + rest[: size - before]]).reshape(-1, width)
            out.append(learner.solved(c + x.T @ x))
        return out

    def _scores(self, models: list[np.ndarray]) -> list[dict]:
        """MAE, RMSE, SUP, R2 and CORR of several sets of weights on the test rows, from one pass; means and squares around them are merged."""
        rows, made = self._test
        w = np.stack(models, 1)

        def merged(a: tuple | None, b: tuple) -> tuple:
            if a is None:
                return b
            n, step = a[0] + b[0], b[1] - a[1]
            return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n, a[3] + b[3] + step * step[0] * a[0] * b[0] / n, a[4] + b[4], a[5] + b[5], np.maximum(a[6], b[6])

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                use = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False))
                if not len(use):
                    continue
                x = to_matrix(b.column(0).take(pa.array(use)))
                y = b.column(1).to_numpy(zero_copy_only=False)[use, None]
                v = np.hstack([y, (x if made is None else made(x)) @ w])
                mean = v.mean(0)
                c, e = v - mean, v[:, 1:] - y
                total = merged(total, (len(v), mean, (c * c).sum(0), (c * c[:, :1]).sum(0), np.abs(e).sum(0), (e * e).sum(0), np.abs(e).max(0)))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total[0]]), *[pa.array([v]) for v in total[1:]]], names=list("nmsceqt"))

        total = None
        for g in sorted(rows.select("x", self.y_col).mapInArrow(part, "n bigint, " + ", ".join(f"{k} array<double>" for k in "msceqt")).collect()):
            total = merged(total, (g.n, *(np.array(v) for v in (g.m, g.s, g.c, g.e, g.q, g.t))))
        if total is None:
            return [dict.fromkeys(("MAE", "RMSE", "SUP", "R2", "CORR")) for _ in models]
        n, _, s, c, e, q, t = total
        with np.errstate(divide="ignore", invalid="ignore"):
            return [{"MAE": e[k] / n, "RMSE": np.sqrt(q[k] / n), "SUP": t[k], "R2": 1 - q[k] / s[0], "CORR": c[k + 1] / np.sqrt(s[0] * s[k + 1])} for k in range(len(models))]

    def save_state(self) -> str:
        return json.dumps(self.results)


#: Ranges of a draw that are counted before those with a wanted rank are looked into.
_RANGES = 1 << 16


def _tallies(ids: DataFrame, id_col: str, seeds: list[str]) -> list[np.ndarray]:
    """For each seed the rows in each range of their draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(_RANGES, np.int64) for _ in seeds]
        for b in batches:
            for k in range(len(seeds)):
                n[k] += np.bincount(np.floor(b.column(k).to_numpy(zero_copy_only=False) * _RANGES).astype(int), minlength=_RANGES)
        for k, v in enumerate(n):
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(v[at])], names=["k", "b", "n"])

    out = [np.zeros(_RANGES, np.int64) for _ in seeds]
    if seeds:
        got = ids.select(*[draw(id_col, s).alias(f"_{k}") for k, s in enumerate(seeds)]).mapInArrow(run, "k bigint, b bigint, n bigint").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
        k, b, n = (got.column(c).to_numpy() for c in ("k", "b", "n"))
        for j in range(len(seeds)):
            out[j][b[k == j]] = n[k == j]
    return out


def learning_curve_stats(scores: list[dict]) -> list[dict]:
    out = []
    for size in sorted({s["size"] for s in scores}):
        mine = [s for s in scores if s["size"] == size]
        one: dict = {"size": size}
        for name in mine[0]:
            if name != "size":
                v = np.array([s[name] for s in mine], float)
                one[name], one[f"{name}_std"] = float(v.mean()), float(v.std())
        out.append(one)
    return out

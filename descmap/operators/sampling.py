"""Subsets: random, sequential, farthest points, CUR, reweighting; splits and folds.

Random choices hash the row's id with a seed (the first 13 hex digits of an MD5 digest as
a fraction), so they are the same in any order of rows, on any number of machines, and in other engines.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descmap.operators.blocks import gram, local, map_matrix, samples, squared_distances, to_matrix
from descmap.operators.graph import numbered

#: Candidates that a partition offers in one round of farthest points.
POOL = 128
#: Landmarks at most, as their own kernel is held in one place; also ids that are sent to all executors.
LANDMARKS = 10_000


def draw(id_col: str | Column, seed: int | str = 0) -> Column:
    """A number in [0, 1) from id and seed."""
    key = F.concat(F.lit(f"{seed}:"), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def count_of(n_or_ratio: float, rows: int) -> int:
    """A count: whole numbers from 2 are counts, 1 and fractions are shares. More than there is is an error."""
    n = int(rows * n_or_ratio) if n_or_ratio == 1 or isinstance(n_or_ratio, float) and n_or_ratio < 1 else int(n_or_ratio)
    if n > rows:
        raise ValueError(f"{n} of {rows} rows")
    return n


def random(df: DataFrame, share: float, id_col: str = "sample_id", seed: int = 0) -> DataFrame:
    """Each row with the probability `share`."""
    return df.where(draw(id_col, seed) < share)


def sequential(df: DataFrame, n: int, id_col: str = "sample_id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def farthest_points(df: DataFrame, n: int, start: int | None = None, id_col: str = "sample_id", x_col: str = "x") -> list[tuple[int, float]]:
    """Ids of n rows, each the farthest from those before, with its squared distance to them (the first: infinite).

    Ties go to the smaller id; start: an id, else the smallest. One pass over the rows finds
    the farthest of each partition, more of them than one; as distances only shrink, further points
    come from these as long as they lie farther than anything the partitions held back.
    """
    rows = samples(df, id_col, x_col)
    first = rows.where(F.col("id") == start) if start is not None else rows.orderBy("id").limit(1)
    got = first.select("id", "x").first()
    if got is None:
        return []
    ids, picks, gaps = [got.id], [np.array(got.x)], [math.inf]
    while len(ids) < n:
        have, known = np.array(picks), set(ids)

        def offer(batches: Iterator[pa.RecordBatch], have=have) -> Iterator[pa.RecordBatch]:
            best: list[tuple[float, int, np.ndarray]] = []
            for b in batches:
                if not b.num_rows:
                    continue
                x, i = to_matrix(b.column(1)), b.column(0).to_numpy()
                d = np.full(len(x), np.inf)
                for k in range(0, len(have), 256):
                    d = np.minimum(d, squared_distances(x, have[k : k + 256]).min(1))
                for k in np.lexsort((i, -d))[: POOL + 1].tolist():
                    item = (float(d[k]), -int(i[k]), x[k])
                    if len(best) <= POOL:
                        heapq.heappush(best, item)
                    elif item[:2] > best[0][:2]:
                        heapq.heapreplace(best, item)
            if best:
                best.sort(key=lambda e: (-e[0], -e[1]))
                bound = best[POOL][0] if len(best) > POOL else -1.0
                top = best[:POOL]
                yield pa.RecordBatch.from_arrays([pa.array([-e[1] for e in top]), pa.array([e[0] for e in top]), pa.array([e[2] for e in top]), pa.array([bound] * len(top))], names=["id", "d", "x", "bound"])

        pool = [r for r in rows.mapInArrow(offer, "id bigint, d double, x array<double>, bound double").collect()]
        bound = max(r.bound for r in pool)
        pool = sorted((r for r in pool if r.id not in known), key=lambda r: r.id)
        if not pool:
            break
        x, d, pid = np.array([r.x for r in pool]), np.array([r.d for r in pool]), np.array([r.id for r in pool])
        fresh = True
        while len(ids) < n and len(pid):
            k = int(np.argmax(d))
            # Within a round that starts with exact distances the farthest is certain; later ones must beat what was held back.
            if not fresh and d[k] <= bound:
                break
            fresh = False
            ids.append(int(pid[k]))
            picks.append(x[k])
            gaps.append(float(d[k]))
            d = np.minimum(d, squared_distances(x, x[k : k + 1])[:, 0])
            x, d, pid = np.delete(x, k, 0), np.delete(d, k), np.delete(pid, k)
    return list(zip(ids, gaps, strict=True))


def cur_rows(df: DataFrame, n: int, id_col: str = "sample_id", x_col: str = "x") -> list[int]:
    """Ids of n rows by leverage on the covariance of rows, each pick projected out.

    With C = X'X the deflated covariance of rows is always X P' X' for a small P, and its leading eigenvectors are X W; so
    each pick is one pass for the largest leverage, and the N x N matrix never exists.
    """
    rows = samples(df, id_col, x_col)
    c = gram(rows).outer
    p = np.eye(len(c))
    out: list[int] = []
    for step in range(n):
        values, w = np.linalg.eig(p.T @ c)
        order = np.argsort(-np.abs(values))[: min(n - step, len(c))]
        w = np.real(w[:, order])
        size = np.einsum("ij,ik,kj->j", w, c, w)
        w = w[:, size > 1e-12] / np.sqrt(size[size > 1e-12])
        scored = map_matrix(rows, "x", "s", lambda x, w=w: ((x @ w) ** 2).sum(1), scalar=True)
        if out:
            scored = scored.where(~F.col("id").isin(out))
        best = scored.agg(F.max(F.struct(F.round("s", 12).alias("s"), (-F.col("id")).alias("m"), "x")).alias("b")).first().b
        if best is None:
            break
        out.append(-best.m)
        x = np.array(best.x)
        b = p @ x  # in terms of the rows: the selected column of the covariance is X b
        norm = b @ c @ b
        if norm <= 1e-15:
            continue
        p = p - np.outer(b, b @ c @ p) / norm
    return out


def cur_columns(df: DataFrame, n: int, rank: int | None = None, weights: np.ndarray | None = None, x_col: str = "x") -> list[int]:
    """Positions (ascending by leverage) of the n columns of largest leverage in the leading right singular vectors."""
    c = gram(df, x_col).outer
    rank = rank or min(len(c) - 1, max(1, n // 2))
    _, v = np.linalg.eigh(c)
    lev = (v[:, -rank:] ** 2).sum(1) / rank
    if weights is not None:
        lev = lev * np.asarray(weights)
        lev = lev / lev.sum()
    return np.argsort(lev, kind="stable")[-n:].tolist()


def sparsify(df: DataFrame, mode: str, n_or_ratio: float, id_col: str = "sample_id", x_col: str = "x", seed: int = 0) -> DataFrame:
    """The rows that a mode (fps, cur, random, sequential) keeps."""
    mode = mode.lower()
    rows = df.count()
    n = count_of(n_or_ratio, rows)
    if mode == "random":
        return random(df, n / rows if rows else 0, id_col, seed)
    if mode == "sequential":
        return sequential(df, n, id_col)
    if mode == "fps":
        ids = [i for i, _ in farthest_points(df, n, None, id_col, x_col)]
    elif mode == "cur":
        ids = cur_rows(df, n, id_col, x_col)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    keep = df.sparkSession.createDataFrame([(i,) for i in ids], f"`{id_col}` bigint")
    return df.join(F.broadcast(keep) if len(ids) <= LANDMARKS else keep, id_col, "left_semi")


def reweight(df: DataFrame, log_density: str, n: int, scale: float, id_col: str = "sample_id", seed: int = 0) -> DataFrame:
    """Rows kept with a probability as exp(log density / scale - log density), n of them in expectation."""
    w = F.exp(F.col(log_density) / scale - F.col(log_density))
    total = df.agg(F.sum(w)).first()[0] or 1.0
    return df.where(draw(id_col, seed) < w * n / total)


def exponential_split(low: int, high: int, n: int = 5) -> list[int]:
    """n whole numbers from low to high, evenly spaced by logarithm."""
    if n < 2:
        return [high][:n]
    step = (math.log(high) - math.log(low)) / (n - 1)
    return [low, *(int(math.exp(math.log(low) + k * step)) for k in range(1, n - 1)), high]


def random_split(df: DataFrame, share: float, id_col: str = "sample_id", seed: int = 0) -> DataFrame:
    """df with is_test, true with probability `share`."""
    return df.withColumn("is_test", draw(id_col, seed) < share)


def kernel_random_split(kernel: DataFrame, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, train) and (test, train) entries of a kernel (i, j, k)."""
    i, j = draw("i", seed) < share, draw("j", seed) < share
    return kernel.where(~i & ~j), kernel.where(i & ~j)


def k_fold(df: DataFrame, k: int = 3, shuffle: bool = False, id_col: str = "sample_id", seed: int = 0) -> DataFrame:
    """df with fold: consecutive runs of rows by id (shuffled: by draw), whose sizes differ by one at most."""
    n = df.count()
    if shuffle:
        df = df.withColumn("_d", draw(id_col, seed))
    placed = numbered(df, *(["_d", id_col] if shuffle else [id_col]), name="_n").drop("_d")
    long = n % k
    edge = long * (n // k + 1)
    fold = F.when(F.col("_n") < edge, F.floor(F.col("_n") / (n // k + 1))).otherwise(F.floor((F.col("_n") - edge) / max(1, n // k)) + long)
    return placed.withColumn("fold", fold.cast("int")).drop("_n")


def shuffle_split(df: DataFrame, n_splits: int, test_share: float, id_col: str = "sample_id", seed: int = 0) -> DataFrame:
    """df for each split, with split and is_test."""
    splits = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return splits.withColumn("is_test", draw(F.concat_ws(":", "split", F.col(id_col).cast("string")), seed) < test_share)


def learning_curve_split(df: DataFrame, sizes: list[int], repeats: int, id_col: str = "sample_id", seed: int = 0) -> DataFrame:
    """(size, repeat, id): for each size and repeat the rows of smallest draw."""
    rows = df.select(F.col(id_col).alias("id"))
    out = None
    for r in range(repeats):
        chosen = numbered(rows.withColumn("_d", draw("id", f"{seed}/{r}")).orderBy("_d", "id").limit(max(sizes)), "_d", "id", name="_n")
        one = chosen.select(F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"), F.lit(r).alias("repeat"), "id", "_n").where("_n < size").drop("_n")
        out = one if out is None else out.unionByName(one)
    return out


def landmarks(df: DataFrame, mode: str = "fps", n: int | None = None, id_col: str = "sample_id", x_col: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a sparse set: a tenth of the rows by number 20ths, ten at least, if n is not given; n < 0: all."""
    rows = df.count()
    n = max(10, rows // 20) if n is None else rows if n < 0 else n
    if n > LANDMARKS:
        raise ValueError(f"{n} landmarks make a kernel of {n} x {n} on the driver; give {LANDMARKS} at most")
    return local(samples(sparsify(df, mode, min(n, rows) if n != 1 else 1.0, id_col, x_col), id_col, x_col))

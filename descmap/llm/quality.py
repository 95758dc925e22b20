"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < G share one weight for each feature; thresholds t_1 <= ... <= t_G say
how much a text needs for each grade: P(grade >= k) = 1 / (1 + exp(t_k - w.x)). Features are
the text's different words, hashed, and its shape (shares of capitals, digits, symbols,
table bars and different words, word length, in steps). The expected grade is the sum
of the tail probabilities; a document is kept if the tail at `at_least` reaches `cut`.

The weights are fitted on the driver to a bounded sample of rated rows: `sample` rows in
expectation, chosen by a hash of the id. Features seen in fewer than `MIN_DOCS` of them have no
weight, nor have those among whose rows the grades are spread as chance would have it (within `SCREEN` standard
deviations, at every threshold). Null texts count as empty and have shape features only. Without rated rows every
text has the top grade with probability 1. Of an id rated repeatedly the highest grade counts. Extra columns pass through; one that has
the name of an added column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import column, quoted, room, sub_batches, table, takes_memory
from descmap.llm.decontam import words_of

BUCKETS = 1 << 18
MIN_DOCS = 4
SCREEN = 5.0
#: Rated rows that are learned from, in expectation.
SAMPLE = 20_000
CACHE = 200_000
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()|")


def shape(raw: bytes, words: list[bytes], different: int) -> list[bytes]:
    """The text's shape as a few named steps."""
    n, k = max(1, len(raw)), max(1, len(words))
    out = []
    for name, some in (("upper", _UPPER), ("digit", _DIGIT), ("symbol", _SYMBOL), ("bar", b"|")):
        share = (len(raw) - len(raw.translate(None, some))) / n
        level = 0 if not share else 13 + max(-12, int(np.floor(np.log2(share))))
        out += [f"\0{name}{k}".encode() for k in range(1, level + 1)]  # every step reached, so that steps add up
    out.append(f"\0different{int(10 * different / k)}".encode())
    out.append(f"\0length{min(12, len(raw) // k)}".encode())
    out.append(f"\0words{len(words).bit_length()}".encode())
    return out


def features(text: str) -> set[bytes]:
    words = words_of(text)
    some = set(words)
    return some.union(shape(text.encode(), words, len(some)))


def hashed(feature: bytes) -> int:
    return crc32(feature) & (BUCKETS - 1)


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[bytes, tuple[int, float]] = {}

    def __getstate__(self):
        return self.weights, self.thresholds

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        self.known = {}

    def scores(self, texts: list[str]) -> list[float]:
        out = []
        takes_memory("quality", self._forget)
        for t in texts:
            if len(self.known) > CACHE:
                self._forget()
            known, some = self.known, features(t)
            # Each bucket counts once, as in training.
            for f in [f for f in some if f not in known]:
                h = hashed(f)
                known[f] = (h, float(self.weights[h]))
            out.append(sum(dict(map(known.__getitem__, some)).values()))
        return out

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def thresholds_of(steps: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the steps between them."""
    return np.concatenate([steps[:1], steps[0] + np.cumsum(np.exp(steps[1:]))])


def likelihood(par: np.ndarray, col: np.ndarray, of: np.ndarray, grades: np.ndarray, n: int, d: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with l2 on the weights, and its gradient. par: d weights, then the thresholds' parameters; entry k is feature col[k] of row of[k]."""
    t = thresholds_of(par[d:])
    s = np.bincount(of, par[col], n)
    edge = np.concatenate([[-np.inf], t, [np.inf]])
    with np.errstate(over="ignore"):
        lo, hi = (1 / (1 + np.exp(s - edge[grades + k])) for k in (0, 1))  # P(grade < own), P(grade <= own)
    p = np.maximum(hi - lo, 1e-12)
    dlo, dhi = lo * (1 - lo), hi * (1 - hi)
    ds = (dhi - dlo) / p / n
    dt = np.zeros(len(t) + 2)
    np.add.at(dt, grades + 1, -dhi / p / n)
    np.add.at(dt, grades, dlo / p / n)
    dt = dt[1:-1]
    g = np.concatenate([np.bincount(col, ds[of], d) + l2 * par[:d], [dt.sum()], [dt[k + 1 :].sum() * np.exp(par[d + 1 + k]) for k in range(len(t) - 1)]])
    return float(-np.log(p).mean() + 0.5 * l2 * (par[:d] ** 2).sum()), g


def fit_sparse(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = 1e-4, steps: int = 300, rate: float = 0.08) -> Model:
    """Minimises the mean negative log likelihood with l2 by Adam on all rows; a row is an array of different buckets."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    docs = np.bincount(flat, minlength=BUCKETS)
    far = np.zeros(BUCKETS)
    for k in range(1, n_grades):
        p = (grades >= k).mean()
        if 0 < p < 1:
            seen = np.bincount(flat, (grades >= k)[of].astype(float), BUCKETS)
            far = np.maximum(far, np.abs(seen - docs * p) / np.sqrt(np.maximum(docs, 1) * p * (1 - p)))
    kept = np.flatnonzero((docs >= MIN_DOCS) & (far >= SCREEN))
    slot = np.full(BUCKETS, -1)
    slot[kept] = np.arange(len(kept))
    use = slot[flat] >= 0
    col, of = slot[flat[use]], of[use]
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-4, 1 - 1e-4)
    share = np.minimum.accumulate(share)
    start = np.log((1 - share) / share)
    # thresholds: the first, then logs of the steps, so that they stay in order
    par = np.concatenate([np.zeros(len(kept)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    n, d = len(rows), len(kept)

    for step in range(1, steps + 1):
        _, g = likelihood(par, col, of, grades, n, d, l2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = par[:d]
    return Model(weights, thresholds_of(par[d:]))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """ratings: columns id and grade (0 to n_grades - 1); see the module for the sample."""
    rated = ratings.select(F.col("id"), F.col("grade").cast("int").alias("grade")).where(f"id is not null and grade between 0 and {n_grades - 1}")
    n = rated.count()
    if not n:
        return Model(np.zeros(BUCKETS, np.float32), np.full(n_grades - 1, -600.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 32) / F.lit(float(2**32))
    chosen = rated.where(draw < min(1.0, sample / n)).groupBy("id").agg(F.max("grade").alias("grade"))
    # About `sample` rows of two numbers by construction: small enough to send to every executor.
    both = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, text), F.lit("")).alias("t")).join(F.broadcast(chosen), "id").select("id", "grade", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sorted({hashed(f) for f in features(t)}) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], names=["id", "grade", "f"])

    got = both.mapInArrow(run, f"id {dict(both.dtypes)['id']}, grade int, f array<int>").orderBy("id", "f").toArrow()
    rows = [np.array(x, np.int64) for x in got.column("f").to_pylist()]
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), np.full(n_grades - 1, -600.0))
    return fit_sparse(rows, np.array(got.column("grade").to_pylist(), np.int64), n_grades)


def score(docs: DataFrame, model: Model, text: str = "text", at_least: int = 2, cut: float = 0.5, only_kept: bool = False) -> DataFrame:
    """docs with expected_grade, tail_probability and keep; only_kept: without these, and without the rows not kept."""
    added = ["expected_grade", "tail_probability", "keep"]
    docs = docs if only_kept else room(docs, added, (text,))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text)
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)
    if not only_kept:
        ddl += ", expected_grade double, tail_probability double, keep boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            s = [x for part in sub_batches([t or "" for t in b.column(at).to_pylist()]) for x in model.scores(part)]
            tails = model.tails(np.array(s, np.float64))
            keep = pa.array(tails[:, at_least - 1] >= cut)
            if only_kept:
                yield b.filter(keep)
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, at_least - 1]), keep], names=[*names, *added])

    return docs.mapInArrow(run, ddl)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of labelled documents: 0 toxic, 1 of low quality, 2 good."""
    return labels.where("quality is not null or toxic is not null").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of the top grade for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, ratings(table(spark, sf_dir, "labels")), 3)
    return score(docs, model).select("doc_id", "expected_grade", "tail_probability", "keep")

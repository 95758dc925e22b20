"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to `order` bytes with the counts of the
bytes that followed. A byte's code length is that of its longest seen context, after
an escape from every longer one that didn't have the byte (escape probability d / (n + d)
for n sightings of d different bytes, method C). Statistics are frozen after training, so a
code length depends on the last order + 1 bytes alone: lengths of all windows seen in
training are tabulated for all languages at once, longest first; a window that no
language has seen pays the escapes of its context and goes to the next shorter table.

A text is lower-cased and runs of other characters than letters become one space. The
language with the shortest code wins (ties: first in order of name); the score is the
softmax of the code lengths, in nats. Null texts and texts without a letter are `und`
with score 0; so is everything if nothing was learned. Extra columns pass through; one that has the name of an added column is
replaced.

Training takes a bounded sample of the labelled rows: `per_language` rows of each
language in expectation, chosen by a hash of the id and not by place; languages with
fewer rows give all. The counts of their bytes are gathered by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import column, quoted, room, sub_batches, table

ORDER = 3
#: Labelled rows of a language that are learned from, in expectation.
PER_LANGUAGE = 500
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normal(text: str) -> bytes:
    """Lower-case letters with one space before, between and after words; empty if there is no letter."""
    if not _LETTER.search(text):
        return b""
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode()


def windows(flat: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place, packed; places before the first n - 1 bytes wrap to zeros."""
    out = np.zeros(len(flat), np.uint64)
    for k in range(n):
        part = flat[: len(flat) - k].astype(np.uint64) << np.uint64(8 * k)
        out[k:] |= part
    return out


class Table:
    """Rows of a matrix by 64-bit key, in a hash table with open addressing."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.rows = np.ascontiguousarray(rows, np.float32)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.row = np.zeros(1 << self.bits, np.int32)
        self.probes, at, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, one = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[one]
            self.keys[at[took]], self.row[at[took]] = keys[left[took]], left[took]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if there is none."""
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = None
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys
            if todo is None:
                out[hit] = self.row[at[hit]]
            else:
                out[todo[hit]] = self.row[at[hit]]
            more = np.flatnonzero(~hit & (there != np.uint64(2**64 - 1)))
            if not len(more):
                break
            todo = more if todo is None else todo[more]
            keys, at = keys[more], (at[more] + 1) & self.mask
        return out


class Model:
    """Code lengths of all seen windows and escapes of all seen contexts, by length, a column for each language.

    counts: for each language and context length the packed windows and their sightings.
    """

    def __init__(self, languages: list[str], counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages, self.order = languages, order
        n = len(languages)
        self.zero = np.full(n, np.log(256.0), np.float32)  # below all contexts: every byte alike
        self.cost: list[Table] = []
        self.escape: list[Table] = []
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for k in range(order + 1):
            got = [counts.get((x, k), none) for x in languages]
            keys = np.unique(np.concatenate([g[0] for g in got])) if got else none[0]
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(contexts), n))
            below = self._lengths(keys & np.uint64((1 << (8 * k)) - 1), k - 1)
            cost = np.empty((len(keys), n))
            at_context = np.searchsorted(contexts, keys >> np.uint64(8))
            for j, (mine, seen) in enumerate(got):
                own = np.searchsorted(contexts, mine >> np.uint64(8))
                total = np.bincount(own, seen, len(contexts))
                kinds = np.bincount(own, minlength=len(contexts))
                has = total > 0
                escape[has, j] = np.log((total[has] + kinds[has]) / kinds[has])
                cost[:, j] = escape[at_context, j] + below[:, j]
                at = np.searchsorted(keys, mine)
                cost[at, j] = np.log((total + kinds)[own] / seen)
            self.cost.append(Table(keys, cost))
            self.escape.append(Table(contexts, escape))

    def _lengths(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of windows of k + 1 bytes, one column for each language."""
        if k < 0:
            return np.broadcast_to(self.zero, (len(keys), len(self.languages)))
        row = self.cost[k].find(keys)
        out = self.cost[k].rows[np.maximum(row, 0)] if len(self.cost[k].rows) else np.zeros((len(keys), len(self.languages)), np.float32)
        if len(lost := np.flatnonzero(row < 0)):
            context = self.escape[k].find(keys[lost] >> np.uint64(8))
            paid = np.where(context[:, None] >= 0, self.escape[k].rows[np.maximum(context, 0)], 0) if len(self.escape[k].rows) else 0
            out[lost] = paid + self._lengths(keys[lost] & np.uint64((1 << (8 * k)) - 1), k - 1)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Nats of each normalised text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], np.int64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        keys = windows(flat, self.order + 1)
        # A text's first bytes have shorter contexts: they must not see the text before.
        early = [np.minimum(begin + k, len(flat) - 1) for k in range(self.order)]
        lengths = self._lengths(keys, self.order)
        for k, at in enumerate(early):
            at = at[k < sizes[full]]
            lengths[at] = self._lengths(keys[at] & np.uint64((1 << (8 * (k + 1))) - 1), k)
        out[full] = np.add.reduceat(lengths, begin, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        made = [normal(t) if t else b"" for t in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        lengths = self.code_lengths(made)
        best = lengths.argmin(axis=1)
        score = 1 / np.exp(lengths.min(axis=1)[:, None] - lengths).sum(axis=1)
        return [self.languages[b] if m else "und" for b, m in zip(best.tolist(), made, strict=True)], [s if m else 0.0 for s, m in zip(score.tolist(), made, strict=True)]


def _count(texts: list[str], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    made = [m for t in texts if t and (m := normal(t))]
    flat = np.frombuffer(b"".join(made), np.uint8)
    inside = np.concatenate([np.arange(len(m)) for m in made]) if made else np.zeros(0, np.int64)
    for k in range(order + 1):
        yield k, *np.unique(windows(flat, k + 1)[inside >= k], return_counts=True)


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, order: int = ORDER) -> Model:
    """The model of rows with a non-null language; see the module for the sample."""
    rows = labelled.select(column(labelled, id_col).alias("i"), column(labelled, text).alias("t"), column(labelled, lang).alias("l")).where("l is not null and t is not null")
    totals = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model([], {}, order)
    share = F.create_map(*[F.lit(x) for l, n in totals.items() for x in (l, min(1.0, per_language / n))])
    # the upper 32 bits of a hash, as a fraction
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "i", "t"), 32) / F.lit(float(2**32))
    sample = rows.where(draw < share[F.col("l")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for l, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                by.setdefault(l, []).append(t)
            for l, texts in by.items():
                for k, keys, seen in _count(texts, order):
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(keys)), pa.array([k] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(seen.astype(np.int64))], names=["l", "k", "w", "n"])

    summed = sample.select("t", "l").mapInArrow(run, "l string, k int, w bigint, n bigint").groupBy("l", "k", "w").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for (l, k), g in summed.groupby(["l", "k"]):
        keys, seen = g["w"].to_numpy().astype(np.int64).view(np.uint64), g["n"].to_numpy()
        by_key = np.argsort(keys)
        counts[l, int(k)] = (keys[by_key], seen[by_key])
    return Model(sorted({l for l, _ in counts}), counts, order)


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score."""
    docs = room(docs, [lang, score], (text,))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text)
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {quoted(lang)} string, {quoted(score)} double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, scores = [], []
            for part in sub_batches([t or "" for t in b.column(at).to_pylist()], 1_000_000):
                l, s = shared.value.predict(part)
                found += l
                scores += s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, lang, score])

    return docs.mapInArrow(run, ddl)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; a third of the documents, by crc32 of the id, is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    out = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")

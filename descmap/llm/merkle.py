"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut without loss: into sections (each ends with an empty line), these into
paragraphs (lines), these into pieces of at most `PIECE` words that end with a sentence. A leaf's
digest is that of its exact characters, an inner node's that of its children's digests and
kind, so the roots of two texts are equal only if the texts are, and the differing
branches lead to the edits. Null and empty texts have the root of a tree without leaves.

Two trees are compared from the root: branches with equal digests are common and not entered, those that differ lead to
the edits. The likeness is the share of characters in common branches, 2 x common / (own + other); as equal branches
have equal leaves, it is that of the leaves both have, each as often as both have it. It is 1 for two empty trees.

Rows of one id follow each other by a 64-bit hash of their text, rows without an id come last; repeated rows are rows as any other. An empty
table gives an empty result. Extra columns of the documents are ignored. Long texts take memory in proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from copy import copy
from hashlib import blake2b, sha256
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import checkpointed, column, table

#: Words of a piece at most.
PIECE = 3
_SECTION = re.compile(r"(?<=\n)(?:[ \t\r]*\n)+")
_PIECE = re.compile(r"(?:[^\s.!?]+[^\S\n]*){1,%d}[.!?]*\s*|[.!?]+\s*|\s+" % PIECE)
#: Bytes of text of one range of ids, about.
RANGE_BYTES = 16_000_000


def sections(text: str) -> list[str]:
    out, last = [], 0
    for m in _SECTION.finditer(text):
        out.append(text[last : m.end()])
        last = m.end()
    if last < len(text):
        out.append(text[last:])
    return out


def _digest(kind: bytes, parts: list[bytes]) -> bytes:
    return blake2b(b"".join(parts), digest_size=16, person=kind).digest()


def tree(text: str | None) -> tuple:
    """A node is (digest, characters, children); the document's children are sections, theirs paragraphs, theirs leaves without children."""
    made = []
    for s in sections(text or ""):
        paragraphs = []
        for p in [s] if "\n" not in s else re.findall(r"[^\n]*\n|[^\n]+", s):
            leaves = [(blake2b(x.encode(), digest_size=16).digest(), len(x), ()) for x in _PIECE.findall(p)]
            paragraphs.append(_node(b"paragraph", leaves))
        made.append(_node(b"section", paragraphs))
    return _node(b"document", made)


def _node(kind: bytes, children: list[tuple]) -> tuple:
    return _digest(kind, [c[0] for c in children]), sum(c[1] for c in children), children


def descend(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int, int]]]:
    """Characters of the branches that both trees have, and the leaves of b (section, paragraph, piece) below branches that a doesn't have."""
    if a[0] == b[0]:
        return a[1], []
    common = 0
    left, right = [a], [((), b)]
    while True:
        # one level down, only below what differs
        left = [c for x in left for c in x[2]]
        right = [((*at, k), c) for at, x in right for k, c in enumerate(x[2])]
        has = Counter(c[0] for c in left)
        rest = []
        for at, c in right:
            if has[c[0]] > 0:
                has[c[0]] -= 1
                common += c[1]
            else:
                rest.append((at, c))
        kept = []
        for c in left:
            if has[c[0]] > 0:
                has[c[0]] -= 1
                kept.append(c)
        left, right = kept, rest
        if not right or len(right[0][0]) == 3:
            return common, [at for at, _ in right]


def compared(a: tuple, b: tuple) -> tuple[int, int]:
    """What `descend` finds, with the number of b's differing leaves only."""
    if a[0] == b[0]:
        return a[1], 0
    common, left, right = 0, [a], [b]
    for _ in range(2):  # sections, paragraphs
        left, right = [c for x in left for c in x[2]], [c for x in right for c in x[2]]
        if len(left) == 1 == len(right):
            if left[0][0] == right[0][0]:
                return common + left[0][1], 0
            continue
        has = Counter([c[0] for c in left])
        rest = []
        for c in right:
            if has.get(c[0], 0) > 0:
                has[c[0]] -= 1
                common += c[1]
            else:
                rest.append(c)
        kept = []
        for c in left:
            if has[c[0]] > 0:
                has[c[0]] -= 1
                kept.append(c)
        left, right = kept, rest
    x, y = Counter(chain.from_iterable(p[2] for p in left)), Counter(chain.from_iterable(p[2] for p in right))
    n = y.total()
    if len(y) < len(x):
        x, y = y, x
    for leaf, k in x.items():
        if other := y.get(leaf):
            same = k if k < other else other
            common += leaf[1] * same
            n -= same
    return common, n


def likeness(a: tuple, b: tuple, common: int | None = None) -> float:
    if not a[1] + b[1]:
        return 1.0
    return 2 * (compared(a, b)[0] if common is None else common) / (a[1] + b[1])


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}


def with_next(docs: DataFrame, fn, out: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that fn(id, text, next text) makes of each document and the next one by ascending id; after the last comes the first.

    Documents are dealt by ranges of ids once and walked in order. A range's last document waits for the first of the
    next range: these two texts of every range are kept beside the rows made, and matched by the range's number. fn is to be a
    small picklable callable; every walk takes a copy.
    """
    t = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(column(docs, id_col).cast("bigint").alias("i"), t.alias("t")).select(F.col("i").isNull().alias("n"), "i", F.xxhash64("t").alias("h"), "t")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # Keys of three numbers: texts don't go into the sample that the bounds of the ranges come from.
    dealt = rows.repartitionByRange(ranges, "n", "i", "h").sortWithinPartitions("n", "i", "h").select("i", "t")
    names, kinds = zip(*(c.strip().split(" ") for c in out.split(",")), strict=True)
    schema = pa.schema([(c, _KINDS[k]) for c, k in zip(names, kinds, strict=True)])
    more = pa.schema([("_range", pa.int64()), ("_i", pa.int64()), ("_first", pa.string()), ("_last", pa.string())])

    def made(rows_: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in rows_], f.type) for k, f in enumerate(schema)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, held = copy(fn), None, None
        for b in batches:
            found = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held is None:
                    first = t
                else:
                    found.append(own(*held, t))
                held = (i, t)
            if found:
                yield pa.RecordBatch.from_arrays([*made(found), *(pa.nulls(len(found), f.type) for f in more)], names=[*names, *more.names])
        if held is not None:
            ends = [pa.array([v], f.type) for v, f in zip((TaskContext.get().partitionId(), held[0], first, held[1]), more, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in schema), *ends], names=[*names, *more.names])

    both = checkpointed(dealt.mapInArrow(walk, out + ", _range bigint, _i bigint, _first string, _last string"))
    ends = both.where("_range is not null").select(*more.names)
    # Numbers alone go to the driver, one for each range.
    order = sorted(r._range for r in ends.select("_range").collect())
    after = docs.sparkSession.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "_range bigint, _next bigint")
    firsts = ends.select(F.col("_range").alias("_next"), F.col("_first").alias("_after"))
    last = ends.select("_range", "_i", "_last").join(after, "_range").join(firsts, "_next").select("_i", "_last", "_after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy(fn)
        for b in batches:
            yield pa.RecordBatch.from_arrays(made([own(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]), names=list(names))

    return both.where("_range is null").select(*names).unionByName(last.mapInArrow(close, out))


class _Seen:
    """The tree of the text that was next, since it comes itself in the row after."""

    def __init__(self):
        self.text, self.made = None, None

    def __call__(self, i, text: str, after: str) -> tuple:
        own = self.made if self.text == text else tree(text)
        nxt = own if after == text else tree(after)
        self.text, self.made = after, nxt
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        new = tree(edited)
        common, changed = compared(own, new)
        return i, n, sha256(edited.encode()).hexdigest(), own[0].hex(), new[0].hex(), likeness(own, new, common), likeness(own, nxt), changed


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to that and to the next document, and the number of the edited text's leaves that lie below differing branches."""
    out = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_changed bigint"
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), _Seen(), out)

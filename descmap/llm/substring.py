"""Substring dedup: a count-min prefilter, then exact grouping of the windows estimated repeated.

A window is `window` consecutive words of one document. A window repeats if the same
words start earlier: in a document of smaller id (null ids are the largest), or earlier in the same
document. Every word that a repeating window covers is removed; windows are judged on
the input. Words are runs without ASCII white space, unchanged. Null, empty and short texts have no
windows. Ids are of any type that sorts. Rows that share an id count as one document each, in order of
a 64-bit hash of their text; of equal rows one is the first.

Documents are dealt by a hash of id and text into groups of about `GROUP_BYTES`, once; all passes
read the same exchange.

1. Each group counts its windows in a count-min sketch of DEPTH rows of counters. Rows are as wide
   as the windows are many (CELLS counters for each window at least), so the share of counters hit twice by chance is the
   same at every size. A group's sketch is sent as its counters that aren't zero, cut into buckets of BUCKET
   counters; buckets are merged by addition (counts of two and more are alike). A merged counter is never below the
   count of any window in it. Each group gets back those of its counters that are two at least.
2. Each group sends the windows all of whose counters are, each once, with its document and the place where it first
   stands: 96 bits of two independent polynomials over 64-bit word hashes. Windows are grouped exactly and each
   group is told which of its windows start earlier elsewhere. Where a window stands again in its group is known there.
3. Each group cuts what it is told. No window is hashed again.

No step gathers more than a group's windows or a bucket's counters, whatever repeats:
a passage in a third of all documents is one row for each group that has it. A group makes a row for each bucket, so
rows number groups x buckets: few (tens of thousands for 1 GB, 2 million for 30 GB, each of a thousand windows and more),
but with the square of the input in the end; beyond some 10 TB both sizes should be raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import column, ddl, fresh, quoted, room, sub_batches, table, takes_memory

WINDOW = 20
#: Bytes of text of a group, about, and groups at least.
GROUP_BYTES, GROUPS = 8_000_000, 96
#: Rows of the sketch; counters for each window in a row at least; counters of a bucket at most and buckets of a row at least, as powers of two.
DEPTH, CELLS, BUCKET, BUCKETS = 2, 8, 26, 4
WORDS = 300_000
_M1, _M2, _TURN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
#: What the window's hash is multiplied with for each row of the sketch.
_ROWS = (1, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _forget_all() -> None:
    _HASHES.clear()


def _poly(a: np.ndarray, multiplier: int, window: int) -> np.ndarray:
    """Polynomial of every `window` neighbours, by doubling."""
    power, out, done, k, part = 1, None, 0, 1, a
    m = multiplier
    while True:
        if window & k:
            # the runs of k that follow what is done
            out = part if out is None else out[: len(part) - done] * np.uint64(power_of(multiplier, k)) + part[done:]
            done += k
        if done == window:
            return out
        part = part[: len(part) - k] * np.uint64(m) + part[k:]
        m, k = m * m % 2**64, 2 * k


def power_of(m: int, k: int) -> int:
    return pow(m, k, 2**64)


class Windows:
    """Words and windows of some texts, in order; at: place of each window's first word among all words."""

    def __init__(self, texts: list[str | None], window: int):
        takes_memory("substring", _forget_all)
        split = [(t or "").encode().split() for t in texts]
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))
        self.words = [w for s in split for w in s]
        n, get = len(self.words), _HASHES.__getitem__
        if n < window:
            self.at, self.h1, self.h2 = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            return
        a = np.fromiter(map(get, self.words), np.uint64, n)
        last = np.repeat(self.begin[1:], self.sizes)[: n - window + 1]
        self.at = np.flatnonzero(np.arange(n - window + 1) + window <= last)
        self.h1 = _poly(a, _M1, window)[self.at]
        self.h1 ^= self.h1 >> np.uint64(32)
        self.h1 *= np.uint64(_TURN)
        self.h2 = (_poly(a * np.uint64(_TURN) ^ a >> np.uint64(29), _M2, window)[self.at] >> np.uint64(32)).astype(np.uint32)


def pack(values: np.ndarray, deltas: bool = True) -> bytes:
    """Whole numbers (deltas: ascending) byte plane after byte plane, without the upper planes that are zero."""
    v = np.diff(values, prepend=np.uint64(0)) if deltas else values.astype(np.uint64)
    k = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([k]) + v.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unpack(blob: bytes, deltas: bool = True) -> np.ndarray:
    k = blob[0]
    planes = np.zeros(((len(blob) - 1) // k, 8), np.uint8)
    planes[:, :k] = np.frombuffer(blob, np.uint8, offset=1).reshape(k, -1).T
    v = planes.view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if deltas else v


def _slices(sorted_keys: np.ndarray):
    """(key, from, to) of each run of equal keys."""
    if len(sorted_keys):
        cut = np.concatenate(([0], np.flatnonzero(np.diff(sorted_keys)) + 1, [len(sorted_keys)]))
        yield from zip(sorted_keys[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(schema))], schema=schema)


def _within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among the ascending `some`."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def cells_of(h1: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each window in a row of 2^bits counters."""
    return ((h1 ^ h1 >> np.uint64(29) if row else h1) * np.uint64(_ROWS[row])) >> np.uint64(64 - bits)


class Sketch:
    """Rows of counters up to two, of one bucket or of a whole small sketch; merged by addition."""

    def __init__(self, bits: int):
        self.count = np.zeros(1 << bits, np.uint8)

    def add(self, once: np.ndarray, more: np.ndarray) -> None:
        """once: different counters hit once, more: hit more often."""
        self.count[once] = np.minimum(self.count[once] + 1, 2)
        self.count[more] = 2

    def repeated(self, cells: np.ndarray) -> np.ndarray:
        return self.count[cells] > 1


def once_and_more(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different cells that stand once, and those that stand more often, in order."""
    cells = np.sort(cells)
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    at = np.flatnonzero(new)
    alone = np.diff(np.append(at, len(cells))) == 1
    return cells[at[alone]], cells[at[~alone]]


_SKETCH = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])
_BACK = pa.schema([("grp", pa.int64()), ("row", pa.int64()), ("some", pa.binary())])
_PLACES = pa.schema([("grp", pa.int64()), ("places", pa.binary())])


def width(size: int) -> int:
    """Counters of a row of the sketch for texts of so many bytes, as a power of two: a window has six bytes or more of its own, about."""
    return max(BUCKETS + 12, (CELLS * (size // 6 + 1)).bit_length())


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, unchanged: bool = True, group_bytes: int = GROUP_BYTES, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """docs with the text that is left, n_words and n_removed (or other names; columns that have them are replaced).

    What is left of a text that loses words is its other words joined by one space; unchanged: texts that
    lose none stay as they are, otherwise their words are joined by one space as well.
    """
    n_words, n_removed = counts
    docs = room(docs, list(counts), (id_col, text))
    size = docs.agg(F.sum(F.octet_length(column(docs, text)))).first()[0] or 0
    groups = max(GROUPS, -(-size // group_bytes))
    bits = width(size)
    buckets = max(BUCKETS, bits - BUCKET)
    low_bits = bits - buckets
    low, shift = np.uint64((1 << low_bits) - 1), np.uint64(low_bits)
    grp, hashed = fresh(docs, "grp"), fresh(docs, "hash")
    rows = docs.select(F.pmod(F.xxhash64(column(docs, id_col), column(docs, text)), F.lit(groups)).alias(grp), F.xxhash64(column(docs, text)).alias(hashed), *[column(docs, c) for c in docs.columns])
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 4)
    dealt = rows.repartition(tasks, grp)
    id_at, text_at, names = docs.columns.index(id_col) + 2, docs.columns.index(text) + 2, docs.columns
    id_type = docs.schema[id_col].dataType.simpleString()

    def ordered(t: pa.Table) -> pa.Table:
        """A group's documents in order; places are counted in words from its start."""
        order = pc.sort_indices(pa.table([t.column(id_at), t.column(1)], names=["i", "t"]), sort_keys=[("i", "ascending"), ("t", "ascending")])
        return t.take(order)

    def parts(t: pa.Table):
        """(place of the first word, number of the first document, windows) of runs of a group's documents."""
        word = doc = 0
        for run in sub_batches(pc.fill_null(t.column(text_at), "").to_pylist(), 1_000_000):
            w = Windows(run, window)
            yield word, doc, w
            word, doc = word + len(w.words), doc + len(run)

    def sketch(t: pa.Table) -> pa.Table:
        g, out = t.column(0)[0].as_py(), []
        h1 = np.concatenate([w.h1 for _, _, w in parts(t)])
        for row in range(DEPTH):
            once, more = once_and_more(cells_of(h1, row, bits))
            cut = np.arange((1 << buckets) + 1, dtype=np.uint64) << shift
            a, b = np.searchsorted(once, cut), np.searchsorted(more, cut)
            for k in np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1])).tolist():
                out.append((row << buckets | k, g, pack(once[a[k] : a[k + 1]] & low), pack(more[b[k] : b[k + 1]] & low)))
        return _rows(_SKETCH, out)

    def merge(t: pa.Table) -> pa.Table:
        row, k = divmod(t.column("bucket")[0].as_py(), 1 << buckets)
        total = Sketch(low_bits)
        blobs = lambda c: (x.as_buffer().to_pybytes() for x in t.column(c))
        for once, more in zip(blobs("once"), blobs("more"), strict=True):
            total.add(unpack(once), unpack(more))
        out = []
        for g, once, more in zip(t.column("grp").to_pylist(), blobs("once"), blobs("more"), strict=True):
            once = unpack(once)
            some = np.sort(np.concatenate([once[total.repeated(once)], unpack(more)]))
            if len(some):
                out.append((g, row, pack(some | np.uint64(k) << shift)))
        return _rows(_BACK, out)

    found_ddl = f"bucket bigint, grp bigint, h1 binary, h2 binary, doc binary, places binary, ids array<{id_type}>, hashes array<bigint>, own boolean"

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), *((c, pa.binary()) for c in ("h1", "h2", "doc", "places")), ("ids", pa.list_(left.schema.field(id_at).type)), ("hashes", pa.list_(pa.int64())), ("own", pa.bool_())])
        if not left.num_rows or not right.num_rows:
            return _rows(schema, [])
        left = ordered(left)
        g, of_row = left.column(0)[0].as_py(), np.array(right.column("row").to_pylist())
        blobs = right.column("some").to_pylist()
        flagged = [np.sort(np.concatenate([unpack(blobs[k]) for k in np.flatnonzero(of_row == row)] or [np.zeros(0, np.uint64)])) for row in range(DEPTH)]
        got = []
        for word, doc, w in parts(left):
            some = np.arange(len(w.h1))
            for row in range(DEPTH):
                some = some[_within(cells_of(w.h1[some], row, bits), flagged[row])]
            at = w.at[some]
            got.append((w.h1[some], w.h2[some], doc + np.searchsorted(w.begin, at, "right") - 1, word + at))
        h1, h2, doc, place = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((place, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        first, again = order[new], np.sort(place[order[~new]])
        h1, h2, doc, place = h1[first], h2[first], doc[first], place[first]
        out, nothing = [], pack(np.zeros(0, np.uint64))
        if len(again):
            out.append((g % (1 << buckets), g, nothing, nothing, nothing, pack(again.astype(np.uint64)), [], [], True))
        for k, a, b in _slices(h1 >> np.uint64(64 - buckets)):
            docs_, ref = np.unique(doc[a:b], return_inverse=True)
            out.append((k, g, pack(h1[a:b]), pack(h2[a:b], False), pack(ref.astype(np.uint64), False), pack(place[a:b].astype(np.uint64), False), left.column(id_at).take(pa.array(docs_)).to_pylist(), left.column(1).take(pa.array(docs_)).to_pylist(), False))
        return _rows(schema, out)

    def exact(t: pa.Table) -> pa.Table:
        out = [(g, p) for g, p, own in zip(t.column("grp").to_pylist(), t.column("places").to_pylist(), t.column("own").to_pylist(), strict=True) if own]
        t = t.filter(pc.invert(t.column("own")))
        if not t.num_rows:
            return _rows(_PLACES, out)
        blob = lambda c, d=False: [unpack(x.as_buffer().to_pybytes(), d) for x in t.column(c)]
        h1s, grps, sizes = blob("h1", True), t.column("grp").to_pylist(), pc.list_value_length(t.column("hashes")).to_numpy()
        h1, h2 = np.concatenate(h1s), np.concatenate(blob("h2"))
        # documents by number, then by their place in the order of ids and hashes
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        doc = np.concatenate([d.astype(np.int64) + b for d, b in zip(blob("doc"), begin.tolist(), strict=True)])
        by = pc.sort_indices(pa.table([pc.list_flatten(t.column("ids")), pc.list_flatten(t.column("hashes"))], names=["i", "t"]), sort_keys=[("i", "ascending"), ("t", "ascending")]).to_numpy()
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        rank = place[doc]
        order = np.lexsort((rank, h1))
        same = h1[order][1:] == h1[order][:-1]
        if (h2[order][1:] != h2[order][:-1])[same].any():
            order = np.lexsort((rank, h2, h1))
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        later = np.zeros(len(h1), bool)
        later[order[1:][same]] = True
        at = 0
        for g, own, places in zip(grps, h1s, blob("places"), strict=True):
            p, at = places[later[at : at + len(own)]], at + len(own)
            if len(p):
                out.append((g, pack(np.sort(p))))
        return _rows(_PLACES, out)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left = ordered(left)
        gone = np.sort(np.concatenate([unpack(x) for x in right.column("places").to_pylist()])).astype(np.int64) if right.num_rows else np.zeros(0, np.int64)
        texts, n, removed, word = [], [], [], 0
        for run in sub_batches(pc.fill_null(left.column(text_at), "").to_pylist(), 1_000_000):
            split = [t.encode().split() for t in run]
            begin = np.concatenate(([0], np.cumsum([len(x) for x in split])))
            a, b = np.searchsorted(gone, [word, word + begin[-1]])
            edge = np.zeros(int(begin[-1]) + 1, np.int32)
            np.add.at(edge, gone[a:b] - word, 1)
            np.add.at(edge, gone[a:b] - word + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            lost = np.diff(np.concatenate(([0], np.cumsum(~keep)))[begin])
            for t, x, k, i in zip(run, split, lost.tolist(), begin.tolist()):
                if k:
                    t = b" ".join([y for y, f in zip(x, keep[i : i + len(x)].tolist(), strict=True) if f]).decode()
                elif not unchanged:
                    t = b" ".join(x).decode()
                texts.append(t)
            n += [len(x) for x in split]
            removed += lost.tolist()
            word += int(begin[-1])
        made = pa.array(texts, left.schema.field(text_at).type)
        if (none := pc.is_null(left.column(text_at))).to_numpy().any():
            made = pc.if_else(none.combine_chunks() if isinstance(none, pa.ChunkedArray) else none, pa.scalar(None, made.type), made)
        cols = [made if k == text_at else left.column(k) for k in range(2, left.num_columns)]
        return pa.table([*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*names, n_words, n_removed])

    by_group = dealt.groupBy(grp)
    sketches = by_group.applyInArrow(sketch, "bucket bigint, grp bigint, once binary, more binary")
    flagged = sketches.groupBy("bucket").applyInArrow(merge, "grp bigint, row bigint, some binary")
    found = by_group.cogroup(flagged.groupBy("grp")).applyInArrow(candidates, found_ddl)
    told = found.groupBy("bucket").applyInArrow(exact, "grp bigint, places binary")
    return by_group.cogroup(told.groupBy("grp")).applyInArrow(cut, ddl(docs.schema.fields) + f", {quoted(n_words)} bigint, {quoted(n_removed)} bigint")


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = None, **kw) -> DataFrame:
    """docs with the text that is left; n_chars: a column of text lengths to keep in step."""
    n_words, n_removed = fresh(docs, "n_words"), fresh(docs, "n_removed")
    left = dedup(docs, id_col, text, counts=(n_words, n_removed), **kw)
    cols = [F.when(column(left, n_removed) > 0, F.length(column(left, text)).cast(f.dataType)).otherwise(column(left, f.name)).alias(f.name) if f.name == n_chars else column(left, f.name) for f in docs.schema.fields]
    return left.select(*cols)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, words removed, and the digest of what is left."""
    left = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), unchanged=False)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_sql() -> str:
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, k, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS win FROM d, unnest(range(1, len(w) - {WINDOW - 2})) t(k)),
    again AS (SELECT doc_id, k FROM win QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1),
    gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(k, k + {WINDOW})) t(p)),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

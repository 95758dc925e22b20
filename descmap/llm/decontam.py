"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over item words. A training text streams through it word by
word; the longest suffix that some item contains tells at each word whether a window
of items ends there. Only stretches whose neighbouring word pairs all occur in items
are walked, since no window lies outside of them.

Words are runs of digits, A-Z lower-cased, a-z and non-ASCII characters. A window is
`window` consecutive words of one item; an item of fewer words is one window. Null and
empty texts have no words; null and repeated items are allowed (an item without words
has no window). Extra columns pass through; one that has the name of an added column is replaced.

The automaton goes to the executors as broadcast data. Its bound is `max_words` item
words, on the driver as in every worker; of a larger benchmark one automaton after another is made, and the texts stream through
each in a pass of its own, with the hits so far written in between.
Repeated rows and ids are judged alike. Memory is in proportion to the longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import checkpointed, fresh, quoted, room, sub_batches, table

WINDOW = 10
#: Item words in one automaton at most (some 500 bytes a word).
MAX_WORDS = 500_000
_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, with what is needed to name the items whose windows occur."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.ids, self.names = window, {}, []
        step: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        pairs = set()
        self.single = set()  # words that are windows on their own
        ends: list[tuple[int, list[int]]] = []
        for name, words in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
            if not seq:
                continue
            item = len(self.names)
            self.names.append(name)
            pairs.update(zip(seq, seq[1:]))
            if len(seq) == 1 or window == 1:
                self.single.update(seq)
            last = 0
            for c in seq:
                last = self._extend(step, link, size, last, c)
            ends.append((item, seq))
        self.step, self.link, self.size = step, link, size
        self.pairs = np.array(sorted(a << 32 | b for a, b in pairs), np.int64)
        # items by the state that holds their windows, and for shorter items by the state and length
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, seq in ends:
            state, n = 0, 0
            for c in seq:
                state, n = step[state][c], n + 1  # a substring of the item: always there
                if n >= window or n == len(seq):
                    s = state
                    want = min(window, n) if len(seq) >= window else n
                    if n == len(seq) or len(seq) >= window:
                        while size[link[s]] >= want:
                            s = link[s]
                        if len(seq) >= window:
                            self.full.setdefault(s, set()).add(item)
                        else:
                            self.short.setdefault(s, []).append((want, item))
        # the nearest state on the way to the root, itself included, with shorter items
        order = sorted(range(len(size)), key=size.__getitem__)
        self.near = [-1] * len(size)
        for s in order:
            self.near[s] = s if s in self.short else (self.near[link[s]] if link[s] >= 0 else -1)

    @staticmethod
    def _extend(step, link, size, last, c):
        if c in step[last]:
            q = step[last][c]
            if size[q] == size[last] + 1:
                return q
            clone = len(size)
            step.append(dict(step[q]))
            size.append(size[last] + 1)
            link.append(link[q])
            link[q] = clone
            p = last
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = clone
                p = link[p]
            return clone
        cur = len(size)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p < 0:
            return cur
        q = step[p][c]
        if size[q] == size[p] + 1:
            link[cur] = q
            return cur
        clone = len(size)
        step.append(dict(step[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = link[cur] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return cur

    def walk(self, seq: list[int], offset: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        """Adds the word spans that windows cover, and the items they belong to."""
        step, link, size, w = self.step, self.link, self.size, self.window
        state = n = 0
        for i, c in enumerate(seq):
            while state and c not in step[state]:
                state = link[state]
                n = size[state]
            if c in step[state]:
                state, n = step[state][c], n + 1
            else:
                n = 0
                continue
            if n >= w:
                s = state
                while size[link[s]] >= w:
                    s = link[s]
                if s in self.full:
                    spans.append((offset + i - w + 1, offset + i + 1))
                    items.update(self.full[s])
            s = self.near[state]
            while s >= 0:
                for m, item in self.short[s]:
                    if m <= n:
                        spans.append((offset + i - m + 1, offset + i + 1))
                        items.add(item)
                s = self.near[link[s]] if link[s] >= 0 else -1

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text the number of words, merged hit spans of words, and items."""
        counts, ids = [], []
        get = self.ids.get
        for t in texts:
            found = words_of(t)
            counts.append(len(found))
            ids.append(np.fromiter((get(x, -1) for x in found), np.int64, len(found)))
        begin = np.concatenate(([0], np.cumsum(counts)))
        flat = np.concatenate([*ids, np.array([-1], np.int64)])
        key = flat[:-1] << 32 | flat[1:]
        known = (flat[:-1] >= 0) & (flat[1:] >= 0)
        known[begin[1:][np.array(counts) > 0] - 1] = False  # a text's last word has no neighbour
        where = np.flatnonzero(known)
        if len(self.pairs):
            slot = np.minimum(np.searchsorted(self.pairs, key[where]), len(self.pairs) - 1)
            known[where] = self.pairs[slot] == key[where]
        else:
            known[:] = False
        edge = np.diff(np.concatenate(([False], known, [False])).astype(np.int8))
        runs = [(a, b + 1) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        if self.single:
            alone = np.isin(flat[:-1], np.fromiter(self.single, np.int64, len(self.single)))
            runs += [(i, i + 1) for i in np.flatnonzero(alone).tolist()]
        least = min([self.window, *(m for found in self.short.values() for m, _ in found)])
        out = [(n, [], set()) for n in counts]
        for a, b in runs:
            if b - a >= least:
                k = int(np.searchsorted(begin, a, "right")) - 1
                self.walk(flat[a:b].tolist(), int(a - begin[k]), out[k][1], out[k][2])
        return [(n, merged(spans), items) for n, spans, items in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_words: int) -> Iterator[Automaton]:
    """Automata of runs of items in order, of at most max_words words (one item at least); items come to the driver one run at a time."""
    part: list = []
    size = 0
    rows = benchmark.select(F.col(quoted(id_col)).cast("string").alias("i"), F.col(quoted(text_col)).alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        words = words_of(r.t)
        if part and size + len(words) > max_words:
            yield Automaton(part, window)
            part, size = [], 0
        part.append((r.i, words))
        size += len(words)
    yield Automaton(part, window)


def _scanned(automaton: Automaton, values: list[str]) -> tuple[list, list, list]:
    """Numbers of words, hit spans and hit items of texts."""
    n, spans, items = [], [], []
    for part in sub_batches(values):
        for k, hit, of in automaton.scan(part):
            n.append(k)
            spans.append(hit)
            items.append(sorted({automaton.names[i] for i in of if automaton.names[i] is not None}))
    return n, spans, items


def _pass(docs: DataFrame, automaton: Automaton, text: str, added: tuple[str, str, str], again: bool) -> DataFrame:
    """docs with the columns `added` from one automaton; again: these are there, as the last ones, and gain what it finds."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    names = docs.columns[:-3] if again else docs.columns
    at = names.index(text)
    ddl = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in names)
    ddl += ", {} bigint, {} array<array<int>>, {} array<string>".format(*map(quoted, added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, items = _scanned(shared.value, pc.fill_null(b.column(at).cast(pa.string()), "").to_pylist())
            if again:
                spans = [merged([*map(tuple, old), *new]) for old, new in zip(b.column(len(names) + 1).to_pylist(), spans, strict=True)]
                items = [sorted({*old, *new}) for old, new in zip(b.column(len(names) + 2).to_pylist(), items, strict=True)]
            made = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *made], names=[*names, *added])

    return docs.mapInArrow(run, ddl)


def _passes(docs: DataFrame, automata: Iterator[Automaton], text: str, added: tuple[str, str, str]) -> DataFrame:
    for k, automaton in enumerate(automata):
        docs = _pass(checkpointed(docs) if k else docs, automaton, text, added, k > 0)
    return docs


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (word positions from, to) and hit_items (item ids as strings, sorted)."""
    added = ("n_words", "hit_spans", "hit_items")
    return _passes(room(docs, list(added), (text,)), _automata(benchmark, item_id, item_text, window, max_words), text, added)


def cut(text: str, spans: list[list[int]]) -> str:
    """text without the hit words and what stands between the words of one span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = 0.5, n_chars: str | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without the spans that benchmark windows cover, and without documents covered beyond max_coverage.

    Columns are those of docs; texts without a hit stay as they are. n_chars: a column of text
    lengths to keep in step.
    """
    names = docs.columns
    at, length_at = names.index(text), names.index(n_chars) if n_chars in names else None
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)
    automata = _automata(benchmark, item_id, item_text, window, max_words)
    first, second = next(automata), next(automata, None)
    shared = docs.sparkSession.sparkContext.broadcast(first) if second is None else None
    if second is not None:
        added = tuple(fresh(docs, c) for c in ("n_words", "hit_spans", "hit_items"))
        docs = _passes(docs, chain([first, second], automata), text, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, cols = b.column(at).to_pylist(), list(b.columns[: len(names)])
            if shared is not None:
                n, spans, _ = _scanned(shared.value, [v or "" for v in values])
            else:
                n, spans = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            hit = [k for k, s in enumerate(spans) if s]
            if hit:
                drop = set()
                for k in hit:
                    if sum(y - x for x, y in spans[k]) > max_coverage * n[k]:
                        drop.add(k)
                    else:
                        values[k] = cut(values[k], spans[k])
                cols[at] = pa.array(values, cols[at].type)
                if length_at is not None:
                    lengths = cols[length_at].to_pylist()
                    for k in hit:
                        lengths[k] = len(values[k])
                    cols[length_at] = pa.array(lengths, cols[length_at].type)
                keep = pa.array([k not in drop for k in range(len(values))])
                cols = [c.filter(keep) for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, ddl)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items with occurring windows."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + (s[1] - s[0]).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op6_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = f"least({WINDOW}, len(w))"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    i AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item, {n} AS n, array_to_string(w[k : k + {n} - 1], ' ') AS win FROM i, unnest(range(1, len(w) - {n} + 2)) t(k) WHERE len(w) > 0),
    dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(w) - n + 2)) t(k)),
    hit AS (SELECT DISTINCT doc_id, n, k, item FROM dw JOIN iw USING (win, n)),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, k FROM hit), unnest(range(k, k + n)) t(p) GROUP BY doc_id),
    its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

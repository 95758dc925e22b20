"""Byte-level BPE by corpus-level merge replay.

The distinct chunks of a run of texts are split by the tokenizer's pattern; the
distinct pieces that are not yet known are merged together: an index from token
pair (by the token it makes) to the positions where it stands is drained in rank order, and a merge
looks up only its two neighbours anew. A worker keeps what it has learned, up to a bound,
so a piece is merged once and looked up afterwards.

`pattern` must be one whose matches don't depend on what stands before a space that follows no other white
space, as those of the byte-level tokenizers do: texts are cut there before matching.
Null texts count as empty; empty texts have no ids. Extra columns pass through; a column that has the name of an added
one is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import quoted, room, sub_batches, table, takes_memory

#: Entries that a worker keeps at most; beyond, it forgets all and learns anew.
CACHE = 300_000
#: Words that are merged together at most.
RUN = 50_000
#: Positions of a rank from which its merges are made as arrays.
MANY = 100
NONE, LAST = np.uint64(2**64 - 1), np.uint32(2**32 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary's merges on ids: every way to make a token of two others, by the packed pair."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                    self.pairs[a << 32 | b] = r
        # The same in a table with open addressing, for whole arrays of pairs.
        self.bits = max(4, (2 * len(self.pairs)).bit_length() + 1)
        keys = np.fromiter(self.pairs, np.uint64, len(self.pairs))
        self.keys = np.full(1 << self.bits, NONE, np.uint64)
        self.made = np.full(1 << self.bits, LAST, np.uint32)
        made, at = np.fromiter(self.pairs.values(), np.uint32, len(keys)), self._slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] == NONE
            _, one = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[one]
            self.keys[at[took]], self.made[at[took]] = keys[took], made[took]
            rest = np.ones(len(keys), bool)
            rest[took] = False
            keys, made, at = keys[rest], made[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, LAST if none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right
        at = self._slot(keys)
        out = np.full(len(keys), LAST, np.uint32)
        left_over = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys
            out[left_over[hit]] = self.made[at[hit]]
            more = ~hit & (there != NONE)
            if not more.any():
                break
            left_over, keys, at = left_over[more], keys[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Packed ids of each (non-empty) word: all merges in rank order over all words at once.

    `index` leads from the token that a pair makes to the positions where the pair stands; `rank` has, at each position, what
    the pair that begins there makes. Ranks are taken in order, each at all its positions, and a merge looks up the two pairs
    anew that it touches. Of a word's positions the first is merged and the others wait, so that a pair
    of lower rank that a merge opens goes first, as in a greedy encoder. Ranks with MANY positions
    are merged as arrays, others one by one, on the same memory.
    """
    if not words:
        return []
    flat = np.frombuffer(b"".join(words), np.uint8)
    n = len(flat)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    tok = np.array(merges.byte, np.uint32)[flat]
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[starts + sizes - 1] = -1
    prv[starts] = -1
    rank = np.full(n, LAST, np.uint32)
    inner = np.flatnonzero(nxt >= 0)
    rank[inner] = merges.of(tok[inner], tok[inner + 1])
    order = np.argsort(rank, kind="stable")[: int((rank != LAST).sum())]
    cut = np.flatnonzero(np.diff(rank[order], prepend=LAST)).tolist() if len(order) else []
    index: dict[int, list[int]] = {int(rank[order[i]]): order[i:j].tolist() for i, j in zip(cut, [*cut[1:], len(order)], strict=True)}
    heap = list(index)
    heapq.heapify(heap)
    get, push, pop, last = merges.pairs.get, heapq.heappush, heapq.heappop, int(LAST)
    mtok, mnxt, mprv, mrank, mword = (memoryview(x) for x in (tok, nxt, prv, rank, word))

    def post(made: int, at: int) -> None:
        if made in index:
            index[made].append(at)
        else:
            index[made] = [at]
            push(heap, made)

    while heap:
        r = pop(heap)
        if (at := index.pop(r, None)) is None:
            continue
        if len(at) < MANY:
            at.sort()
            wait, merged = [], -1
            for p in at:
                if mrank[p] != r:
                    continue
                if mword[p] == merged:
                    wait.append(p)
                    continue
                merged, q = mword[p], mnxt[p]
                after, before = mnxt[q], mprv[p]
                mtok[p], mnxt[p], mrank[q] = r, after, last
                x = last
                if after >= 0:
                    mprv[after] = p
                    if (x := get(r << 32 | mtok[after], last)) != last:
                        post(x, p)
                mrank[p] = x
                if before >= 0:
                    mrank[before] = x = get(mtok[before] << 32 | r, last)
                    if x != last:
                        post(x, before)
        else:
            p = np.array(at, np.int32)
            p = np.sort(p[rank[p] == r])
            first = np.diff(word[p], prepend=-1) != 0
            wait, p = p[~first].tolist(), p[first]
            q, before = nxt[p], prv[p]
            after = nxt[q]
            tok[p], nxt[p], rank[q], rank[p] = r, after, LAST, LAST
            inside = after >= 0
            prv[after[inside]] = p[inside]
            made = np.full(len(p), r, np.uint32)
            before = before[before >= 0]
            for lo, left, right in ((p[inside], made[inside], tok[after[inside]]), (before, tok[before], made[: len(before)])):
                rank[lo] = x = merges.of(left, right)
                found = np.flatnonzero(x != LAST)
                for a, b in zip(x[found].tolist(), lo[found].tolist(), strict=True):
                    post(a, b)
        if wait:
            if r in index:
                index[r] += wait
            else:
                index[r] = wait
                push(heap, r)
    # What is left: the positions that lead from each word's start.
    alive = np.zeros(n, bool)
    at = starts
    while len(at):
        alive[at] = True
        at = nxt[at]
        at = at[at >= 0]
    packed = tok[alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))).tolist()
    return [packed[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes runs of texts to packed little-endian unsigned 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.merges, self.find = ranks, Merges(ranks), regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}  # a text's start up to the first space, or a match of the pattern -> ids
        self.spaced: dict[str, bytes] = {}  # what stands between two spaces -> ids, with the space before it

    def _learn(self, pieces: set[str]) -> None:
        """Ids of matches of the pattern that aren't known yet; those of a space and letters are kept without the space."""
        hard: list[tuple[str, bytes]] = []
        for p in pieces:
            w = p.encode()
            if (r := self.ranks.get(w)) is None:
                hard.append((p, w))
            else:
                self._keep(p, r.to_bytes(4, "little"))
        for k in range(0, len(hard), RUN):
            part = hard[k : k + RUN]
            for (p, _), ids in zip(part, replay([w for _, w in part], self.merges), strict=True):
                self._keep(p, ids)

    def _keep(self, piece: str, ids: bytes) -> None:
        if piece[0] == " " and piece[1:].isalpha():
            self.spaced[piece[1:]] = ids
        else:
            self.known[piece] = ids

    def _has(self, piece: str) -> bool:
        return piece in self.known or (piece[0] == " " and piece[1:] in self.spaced)

    def _of(self, piece: str) -> bytes:
        got = self.known.get(piece)
        return self.spaced[piece[1:]] if got is None else got

    def _fill(self, first: set[str], spaced: set[str], more: set[str]) -> None:
        new = {p for p in more if not self._has(p)}
        split: list[tuple[dict, str, list[str]]] = []
        for c in spaced:
            if c.isalpha():
                new.add(" " + c)
            elif c[-1:] in ".,!?;:" and c[:-1].isalpha():
                split.append((self.spaced, c, [" " + c[:-1], c[-1]]))
            else:
                split.append((self.spaced, c, self.find(" " + c)))
        split += [(self.known, c, self.find(c)) for c in first if c]
        self._learn(new | {p for _, _, found in split for p in found if not self._has(p)})
        for into, c, found in split:
            into[c] = b"".join(map(self._of, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) + len(self.known) > CACHE:
            self._forget()
        # A space starts a new match unless white space alone lies between it and the next one; such texts are matched whole.
        cut: list[list[str] | None] = []
        whole: dict[int, list[str]] = {}
        first, spaced, more = set(), set(), set()
        for k, t in enumerate(texts):
            parts = t.split(" ")
            if len(parts) > 1 and ("  " in t or t[0] == " " or t[-1] == " " or any(map(str.isspace, parts))):
                cut.append(None)
                more.update(found := self.find(t))
                whole[k] = found
                continue
            cut.append(parts)
            first.add(parts[0])
            spaced.update(parts[1:])
        self._fill({c for c in first if c not in self.known}, {c for c in spaced if c not in self.spaced}, more)
        out = []
        get = self.spaced.__getitem__
        for k, parts in enumerate(cut):
            if parts is None:
                out.append(b"".join(map(self._of, whole[k])))
            else:
                lead = self.known[parts[0]] if parts[0] else b""
                del parts[0]
                out.append(lead + b"".join(map(get, parts)))
        return out


#: What this worker process has learned, by the broadcast's id.
_ENCODERS: dict[object, Encoder] = {}


def _forget_all() -> None:
    _ENCODERS.clear()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a binary column of ids (packed little-endian unsigned 32-bit); decoded: a column of the bytes that these
    ids stand for, made in the same pass (ids and their decoding then need no second worker for a task).

    The ranks (a vocabulary file, about a megabyte) are read on the driver and broadcast.
    """
    added = [ids, *([decoded] if decoded else [])]
    docs = room(docs, added, (text,))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((load_ranks(ranks_path), pattern))
    key = (ranks_path, pattern)
    names = docs.columns
    at = names.index(text)
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields) + "".join(f", {quoted(a)} binary" for a in added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_memory("bpe", _forget_all)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(*shared.value)
        encoder = _ENCODERS[key]
        token_of = {r: t for t, r in shared.value[0].items()} if decoded else {}
        for b in batches:
            values = pc.fill_null(b.column(at).cast(pa.string()), "").to_pylist()
            made = [[x for part in sub_batches(values) for x in encoder.encode(part)]]
            if decoded:
                made.append([_bytes_of(x, token_of) for x in made[0]])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m, pa.binary()) for m in made)], names=[*names, *added])

    return docs.mapInArrow(run, ddl)


def _bytes_of(packed: bytes, token_of: dict[int, bytes]) -> bytes:
    return b"".join(map(token_of.__getitem__, memoryview(packed).cast("I")))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for; null ids give null."""
    encoded = room(encoded, [out], (ids,))
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    names = encoded.columns
    at = names.index(ids)
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in encoded.schema.fields) + f", {quoted(out)} binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = {r: t for t, r in shared.value.items()}
        for b in batches:
            made = [None if x is None else _bytes_of(x, token_of) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*names, out])

    return encoded.mapInArrow(run, ddl)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids and the text decoded from them, as counts and digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

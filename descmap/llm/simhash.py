"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

A fingerprint's bit is set if more than half of the text's word shingles have it in their
64-bit hash. Fingerprints that differ in at most `bits` bits differ in at most as many of
their eight bytes, so they share at least 8 - bits bytes at the same position: the guaranteed
minimum. The index posts a fingerprint under its bytes at some sets of positions, chosen so
that whoever reaches the minimum meets in one posting list (for four of eight bytes 20
sets of three positions do). Who meets shares fewer bytes than the minimum; the positional bytes
that a pair shares are tallied, pairs below the minimum are dropped, and the bits of the rest compared.

Equal fingerprints are one entry, however many documents have them. A posting list with
more than `block` entries is dealt into blocks, and every two blocks meet in a task of
their own, so no task holds an unbounded list. What leaves a task is not pairs but each
entry's smallest connected entry in it: as many rows as entries, with the same components.

`alike` has the components of another likeness, a share of common shingles (Jaccard) of
`likeness` at least, which 64 bits can't tell. Its fingerprint is a SimHash of WIDE bytes, by
the votes of the text's different shingles. At a likeness of 0.8 two texts differ in 15 % of the bits and
agree in 27 % of the bytes at the same position. The inverted index posts a text under its
KEY bytes at every KEY positions, so who meets shares as many. They are compared in NEAR
of the first bits, and whom these lead to (a group, found as components below) meets again, once and with sets
of shingles: the positional bytes that a pair shares are tallied, pairs below SAME are dropped, and
the sets (as 32-bit hashes) of the rest compared. At a likeness of just 0.8, 1 pair in 13,000 shares no key,
differs in more bits or has a lower tally; above it fewer.

An entry of a group has an edge from nearly every list it is in, all in the same component: edges are contracted to
about one a vertex first. Components are then found over different fingerprints by passing on the smallest
neighbour and jumping along (checkpointed each round), and carried to the documents.

Words are runs without ASCII white space, A-Z lower-cased. Null and empty texts have the
fingerprint zero and are linked like any other; texts with fewer words than a shingle are
one shingle. Null ids never name a component if another id is in it. Extra columns are left out of clusters and stay in
`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from descmap.llm._util import checkpointed, column, quoted, room, table, takes_memory
from descmap.llm.substring import pack, unpack

SHINGLE, BITS = 4, 4
#: Entries of a posting list that one task compares at once.
BLOCK = 32768
#: Fingerprints that one task makes the keys of.
KEYED = 20_000
#: Of the stage on shares of common shingles: words of a shingle, least share; bytes of the fingerprint, of a key, votes of a shingle for each bit.
SHARED, LIKENESS = 5, 0.8
WIDE, KEY, VOTES = 256, 2, 2
#: Bytes that are compared where texts meet, bits in which they may differ; equal bytes of all that a pair has at least.
CHECK, NEAR, SAME = 16, 38, 38
#: Entries of a longer list are compared breadth-first.
SHORT = 256
BLOCK_WIDE = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


#: Odd numbers that make the words of the wide fingerprint's votes from a shingle's hash.
_WORDS = np.random.default_rng(7).integers(0, 2**63, VOTES * WIDE // 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _nothing() -> None:
    """Fingerprints leave nothing in a worker."""


def _shingles(text: str | None, shingle: int) -> list[int]:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    hashes = _shingles(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 100_000):
        part = np.array(hashes[k : k + 100_000], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((_WEIGHTS * (2 * counts > n)).sum(dtype=np.uint64).view(np.int64))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each hash (unsigned) VOTES rows of 8 * WIDE bits."""
    x = (hashes ^ (hashes >> np.uint64(31)))[:, None] * _WORDS
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1).reshape(-1, 8 * WIDE)


def wide_fingerprint(text: str | None, shingle: int = SHARED) -> bytes:
    """A bit is set if over half the votes of the different shingles are for it. Two votes each: sets of few shingles would differ by ties."""
    hashes = np.unique(np.array(_shingles(text, shingle), np.uint64))
    total = np.zeros(8 * WIDE, np.int64)
    step = 255 // VOTES
    for k in range(0, len(hashes), step):
        total += votes(hashes[k : k + step]).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > VOTES * len(hashes)).tobytes()


def shingle_set(text: str | None, shingle: int = SHARED) -> bytes:
    """The different shingles' 32-bit hashes in order, packed; one zero without words."""
    return pack(np.unique(np.array(_shingles(text, shingle) or [0], np.uint64).astype("<u4")).astype(np.uint64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE, drop_text: bool = False, make=fingerprint, kind: str = "bigint") -> DataFrame:
    """docs with each text's fingerprint, or what else `make` makes, of the SQL type `kind`."""
    docs = room(docs, [out], (text,))
    names = docs.columns
    at = names.index(text)
    left = [k for k in range(len(names)) if not (drop_text and k == at)]
    ddl = ", ".join(f"{quoted(docs.schema[k].name)} {docs.schema[k].dataType.simpleString()}" for k in left) + f", {quoted(out)} {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_memory("simhash", _nothing)
        for b in batches:
            made = pa.array([make(t, shingle) for t in b.column(at).to_pylist()], pa.int64() if kind == "bigint" else pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in left), made], names=[*(names[k] for k in left), out])

    return docs.mapInArrow(run, ddl)


def positions(least: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which at least lies in any `least` of the eight positions.

    For least = 4 the positions are dealt into three parts: sets of three lie in one part, or have two in a part and one in the
    next. Four positions have three in a part, or two in one and one in each other.
    """
    if least < 4:
        return list(combinations(range(8), max(1, least - 1)))
    part = [0, 0, 0, 1, 1, 1, 2, 2]

    def fits(three: tuple[int, ...]) -> bool:
        n = [sum(part[k] == p for k in three) for p in range(3)]
        return any(n[p] == 3 or (n[p] == 2 and n[(p + 1) % 3] == 1) for p in range(3))

    return [three for three in combinations(range(8), 3) if fits(three)]


def tally(differ: np.ndarray) -> np.ndarray:
    """How many bytes at the same position the pairs share whose exclusive or `differ` (unsigned) has."""
    return (np.ascontiguousarray(differ).view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=-1, dtype=np.uint8)


def linked(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which pairs link: the count filter first, then the bits of what it leaves."""
    # bitwise_count takes the absolute value of signed numbers: bits are counted in unsigned views
    differ = (a ^ b).view(np.uint64)
    out = tally(differ) >= 8 - bits
    out[out] = np.bitwise_count(differ[out]) <= bits
    return out


def smallest_linked(entries: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each (different) fingerprint the smallest one that links of at most `bits` bits lead to.

    Breadth-first: whoever has been reached is not compared again, so a dense group costs
    little more than one comparison for each of its entries.
    """
    values = np.sort(entries)
    least = values.copy()
    rest = values
    while len(rest):
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            step = max(1, 2_000_000 // len(rest))
            near, frontier = frontier[:step], frontier[step:]
            hit = np.flatnonzero(linked(near[:, None], rest[None, :], bits).any(axis=0))
            if len(hit):
                least[np.searchsorted(values, rest[hit])] = root
                frontier = np.concatenate([frontier, rest[hit]])
                rest = np.delete(rest, hit)
    return _as(entries, values, least)


def _as(entries: np.ndarray, values: np.ndarray, least: np.ndarray) -> np.ndarray:
    return least[np.searchsorted(values, entries)]


def _meetings(keyed: DataFrame, entry: list[str], block: int, index: DataFrame | None = None) -> DataFrame:
    """fps: the entries of every posting list of keyed (p, b and the columns of entry, a key first) that has two at least, or of every two blocks of it. index: the same rows, where counting keyed costs more."""
    # A long list has more than `block` entries, so there are fewer than one for every `block` rows: few and short enough to broadcast.
    long = (keyed if index is None else index).groupBy("p", "b").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(entry[0]), blocks).cast("int")
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    meets = F.when(F.col("n").isNull(), single).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))))
    dealt = keyed.join(F.broadcast(long), ["p", "b"], "left").select("p", "b", *entry, F.inline(meets))
    return dealt.groupBy("p", "b", "i", "j").agg(F.collect_list(F.struct(*entry) if len(entry) > 1 else entry[0]).alias("fps")).select("fps").where(F.size("fps") > 1)


def posted(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """The inverted index: (fp, p, b) for every set of positions p, with the fingerprint's bytes b there."""
    keep = 8 - bits
    if keep < 1:
        raise ValueError("fingerprints that differ in 8 bits need not share a byte")
    one = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255)
    packed = [reduce(lambda a, b: F.shiftleft(a, 8).bitwiseOR(b), [one(k) for k in at], F.lit(0).cast("bigint")).cast("int").alias("b") for at in positions(keep)]
    # Fingerprints are short and each makes many keys: deal them by number, as sizes in bytes would leave them to a few tasks.
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count() // KEYED)
    return fps.repartition(tasks, "fp").select("fp", F.posexplode(F.array(*packed)).alias("p", "b"))


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(fp, other): edges between different fingerprints of the column fp that have the components of all links."""
    units = _meetings(posted(fps, bits), ["fp"], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            flat, sizes = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy()
            at = np.concatenate(([0], np.cumsum(sizes)))
            # Most lists have two entries: all of these at once.
            two = at[:-1][sizes == 2]
            lo, hi = np.minimum(flat[two], flat[two + 1]), np.maximum(flat[two], flat[two + 1])
            near = linked(lo, hi, bits)
            found, of = [hi[near]], [lo[near]]
            for x, n in zip(at[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                values = flat[x : x + n]
                least = smallest_linked(values, bits)
                moved = least != values
                if moved.any():
                    found.append(values[moved])
                    of.append(least[moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(of))], names=["fp", "other"])

    return units.mapInArrow(run, "fp bigint, other bigint").distinct()


def smallest_near(ids: np.ndarray, check: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each id of consecutive lists (of these sizes) the smallest one in its list that pairs of at most NEAR different bits of check (unsigned words) lead to."""
    ends = np.cumsum(sizes)
    least, label = ids.copy(), np.arange(len(ids))
    for x, y in zip((ends - sizes)[sizes > SHORT].tolist(), ends[sizes > SHORT].tolist(), strict=True):
        left = x + np.argsort(ids[x:y])
        while len(left):
            root, frontier, left = left[0], left[:1], left[1:]
            while len(frontier) and len(left):
                step = max(1, 1_000_000 // len(left))
                now, frontier = frontier[:step], frontier[step:]
                hit = (np.bitwise_count(check[now][:, None] ^ check[left][None]).sum(axis=2, dtype=np.uint16) <= NEAR).any(axis=0)
                if hit.any():
                    least[left[hit]] = ids[root]
                    frontier, left = np.concatenate([frontier, left[hit]]), left[~hit]
    # Short lists all at once: each entry with the next of its list, with the one after that ...
    end = np.where(np.repeat(sizes, sizes) > SHORT, 0, np.repeat(ends, sizes))
    at, d, found, n = np.flatnonzero(label + 1 < end), 1, [], 0
    while len(at):
        one = at[label[at] != label[at + d]]
        one = one[np.bitwise_count(check[one] ^ check[one + d]).sum(axis=1, dtype=np.uint16) <= NEAR]
        found.append((one, one + d))
        n += len(one)
        d += 1
        at = at[at + d < end[at]]
        if n > 500_000 or not len(at):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            found, n = [], 0
            while (label[a] != label[b]).any():
                low = np.minimum(label[a], label[b])
                # labels that meet are lowered as well, so that whole components move
                for x in (label[a], label[b], a, b):
                    np.minimum.at(label, x, low)
                label = label[label]
    lowest = ids.copy()
    np.minimum.at(lowest, label, ids)
    return np.where(end > 0, lowest[label], least)


def smallest_alike(ids: np.ndarray, wide: np.ndarray, sets: list[np.ndarray], likeness: float = LIKENESS) -> np.ndarray:
    """For each id the smallest one that links of at least `likeness` lead to. Breadth-first, like `smallest_linked`."""
    least, left = ids.copy(), np.argsort(ids)
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            a = frontier.pop()
            close = left[(wide[left] == wide[a]).sum(axis=1) >= SAME]
            # as many common shingles as the likeness needs can't be in sets of too different sizes
            n = len(sets[a])
            close = [k for k in close.tolist() if likeness * n <= len(sets[k]) * (1 + 1e-9) and likeness * len(sets[k]) <= n * (1 + 1e-9)]
            if not close:
                continue
            sizes = np.array([len(sets[k]) for k in close])
            flat = np.concatenate([sets[k] for k in close])
            common = sets[a][np.minimum(np.searchsorted(sets[a], flat), n - 1)] == flat
            both = np.add.reduceat(common.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
            near = np.array(close)[both / (sizes + n - both) >= likeness]
            if len(near):
                least[near] = ids[root]
                frontier += near.tolist()
                left = left[~np.isin(left, near)]
    return least


def _moved(ids: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    moved = least != ids
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(least[moved])], names=["fp", "other"])


def posted_wide(entries: DataFrame) -> DataFrame:
    """The inverted index: (hash, c0, c1, p, b) for every KEY positions p of wide, with its bytes b there and, in c0 and c1, its first CHECK bytes."""
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.count() // KEYED)
    n = WIDE // KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                wide = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, WIDE)
                check = np.ascontiguousarray(wide[:, :CHECK]).view("<i8")
                cols = (np.repeat(part.column(0).to_numpy(), n), np.repeat(check[:, 0], n), np.repeat(check[:, 1], n), np.tile(np.arange(n, dtype=np.int32), len(wide)), wide.view("<u2").astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hash", "c0", "c1", "p", "b"])

    return entries.select("hash", "wide").repartition(tasks, "hash").mapInArrow(run, "hash bigint, c0 bigint, c1 bigint, p int, b int")


def near_links(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, other): edges that have the components of all pairs of entries (hash, wide) that share a key and differ in at most NEAR of their first bits."""
    units = _meetings(posted_wide(entries), ["hash", "c0", "c1"], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            ids, *check = (x.to_numpy(zero_copy_only=False) for x in col.flatten().flatten())
            yield _moved(ids, smallest_near(ids, np.stack(check, axis=1).view(np.uint64), col.value_lengths().to_numpy().astype(np.int64)))

    return units.mapInArrow(run, "fp bigint, other bigint").distinct()


def alike_links(entries: DataFrame, texts: DataFrame, shingle: int = SHARED, likeness: float = LIKENESS, block: int = BLOCK_WIDE) -> DataFrame:
    """(fp, other): edges between texts of entries (hash, wide, and the id of a row that has the text) that have the components of all links; texts: (id, hash, t)."""
    groups = components(near_links(entries)).select(F.col("fp").alias("hash"), F.col("root").alias("p"), F.lit(0).alias("b"))
    # Of copies the row of smallest id gives the text: rows are dealt by id and hash, so copies, however many, don't meet in a task.
    wanted = entries.join(groups, "hash").select(F.col("hash").alias("_hash"), F.col("id").alias("_id"), "wide", "p", "b")
    some = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("hash", "t", "wide", "p", "b")
    # rows that repeat both id and text are left once
    held = with_fingerprint(some, "t", "set", shingle, drop_text=True, make=shingle_set, kind="binary").dropDuplicates(["hash"])
    units = _meetings(held, ["hash", "wide", "set"], block, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            ids, wide, sets = col.flatten().flatten()
            ids, at = ids.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy())))
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                values = ids[x:y]
                rows = np.frombuffer(b"".join(wide[x:y].to_pylist()), np.uint8).reshape(-1, WIDE)
                least = smallest_alike(values, rows, [unpack(v).astype(np.uint32) for v in sets[x:y].to_pylist()], likeness)
                if (least != values).any():
                    yield _moved(values, least)

    return units.mapInArrow(run, "fp bigint, other bigint").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (fp, other), other never above fp, with the vertices and components of edges, fewer where vertices have many.

    A vertex keeps the edge to its smallest neighbour below it, and its other neighbours below get theirs to that one:
    each edge becomes one, most of them equal. Rounds end when they leave over half of the edges.
    """
    now = checkpointed(edges.select(F.greatest("fp", "other").alias("fp"), F.least("fp", "other").alias("other")))
    left = now.count()
    while left:
        low = now.select("fp", "other", F.min("other").over(Window.partitionBy("fp")).alias("low"))
        now = checkpointed(low.select(F.when(F.col("other") == F.col("low"), F.col("fp")).otherwise(F.col("other")).alias("fp"), F.col("low").alias("other")).distinct())
        was, left = left, now.count()
        if 2 * left > was:
            break
    return now


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): each vertex of the edges (fp, other) with the smallest vertex it is connected to.

    A round takes the smallest root among a vertex and its neighbours in the contracted edges, then that root's
    own root. Rounds are written to the shared checkpoint folder.
    """
    few = contracted(edges)
    both = checkpointed(few.unionByName(few.select(F.col("other").alias("fp"), F.col("fp").alias("other"))))
    roots = checkpointed(both.groupBy("fp").agg(F.least("fp", F.min("other")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("fp").alias("other"), F.col("root").alias("r")), "other").groupBy("fp").agg(F.min("r").alias("r"))
        lower = roots.join(near, "fp").select("fp", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = roots.select(F.col("fp").alias("root"), F.col("root").alias("up"))
        new = checkpointed(lower.join(jump, "root", "left").select("fp", "was", F.least("root", F.coalesce("up", "root")).alias("root")))
        if new.where("was <> root").limit(1).count() == 0:
            return new.select("fp", "root")
        roots = new.select("fp", "root")


def cluster(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """id, hash (of the text), fp, component (the smallest id reachable) and first (whether the row is its component's: that of
    smallest id, then of smallest hash; rows equal in both are all first) of every row of docs."""
    rows = checkpointed(with_fingerprint(_hashed(docs, id_col, text), "t", "fp", shingle, drop_text=True))
    by_fp = checkpointed(rows.groupBy("fp").agg(_least().alias("least")))
    return _carried(rows, by_fp, links(by_fp.select("fp"), bits))


def alike(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHARED, likeness: float = LIKENESS) -> DataFrame:
    """As `cluster`, for links of at least that share of common shingles; fp is the text's hash."""
    some = _hashed(docs, id_col, text)
    rows = checkpointed(with_fingerprint(some, "t", "wide", shingle, drop_text=True, make=wide_fingerprint, kind="binary"))
    by_hash = checkpointed(rows.groupBy("hash").agg(_least().alias("least"), F.first("wide").alias("wide")))
    edges = alike_links(by_hash.select("hash", "wide", F.col("least.id").alias("id")), some, shingle, likeness)
    return _carried(rows.select("id", "hash", F.col("hash").alias("fp")), by_hash.select(F.col("hash").alias("fp"), "least"), edges)


def _hashed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(column(docs, id_col).alias("id"), F.xxhash64(F.coalesce(column(docs, text), F.lit(""))).alias("hash"), column(docs, text).alias("t"))


def _least():
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))


def _carried(rows: DataFrame, by_fp: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (id, hash, fp) with component and first, from (fp, least) and the edges between fps."""
    found = components(edges)
    named = by_fp.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = named.join(found.select(F.col("root")).distinct(), "root", "left_semi")
    low = linked.groupBy("root").agg(F.min("least").alias("low"))
    of_fp = found.join(low, "root").select("fp", "low")
    # Written, so that the rows of a fingerprint that very many texts have can be split over tasks in this join.
    named = checkpointed(by_fp.join(of_fp, "fp", "left").select("fp", F.coalesce("low", "least").alias("low")))
    first = F.col("id").eqNullSafe(F.col("low.id")) & (F.col("hash") == F.col("low.hash"))
    return rows.join(named, "fp").select("id", "hash", "fp", F.col("low.id").alias("component"), first.alias("first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", groups=cluster, **kw) -> DataFrame:
    """The first row of each component that `groups` finds in docs; of rows equal in id and text, one."""
    found = groups(docs, id_col, text, **kw)
    gone = found.where(~F.col("first")).select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    same = column(docs, id_col).eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(column(docs, text), F.lit(""))) == gone["_hash"])
    kept = docs.join(gone, same, "left_anti")
    again = found.where("first").groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1")
    return kept.dropDuplicates([id_col, text]) if again.limit(1).count() else kept


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))

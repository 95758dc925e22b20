"""Every operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from descmap.llm import _util, bpe, decontam, hosts, language, merkle, quality, simhash, substring, template, warc

WORDS = "the of and river stone cloud Über naïve table walks seven green quick lamp over under CASE mixed tail 12 9x".split()


def make(seed: int, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated ids."""
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(k))
    passage = text(30)
    out = []
    for i in range(n):
        t = text(r.randrange(1, 120))
        if i % 5 == 0 and out:
            t = r.choice(out)[1] or ""
        elif i % 7 == 0:
            t = text(15) + "\n" + passage + " " + text(5)
        elif i % 11 == 0 and out and out[-1][1]:
            t = out[-1][1] + " extra"
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (None, passage), (None, text(40)), (n + 3, text(3000)), (n + 4, "same"), (n + 4, "same"), (n + 5, passage + " " + passage)]
    r.shuffle(out)
    return out


EXTRA = "grp string, n_words string, fp string, seg int, id int, t string, lang_pred int, score string, ids int, keep string, hit_spans int, _gone int, _hash int, g int, x int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(1), "doc_id bigint, text string").coalesce(3)


@pytest.fixture(scope="module")
def crowded(spark):
    """Columns whose names operators use themselves."""
    n = len(EXTRA.split(","))
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in make(2, 25)], "doc_id bigint, text string, " + EXTRA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def order(rows):
    return sorted(map(tuple, rows), key=str)


# --- substring


def brute_substring(rows, window):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window,group_bytes,few", [(20, 4_000_000, False), (4, 200, False), (1, 5000, False), (4, 200, True)])
def test_substring(docs, window, group_bytes, few, monkeypatch):
    """few: a sketch of so few counters that most of them are hit twice by chance loses and adds nothing."""
    if few:
        monkeypatch.setattr(substring, "width", lambda size: 10)
    got = substring.dedup(docs, window=window, unchanged=False, group_bytes=group_bytes).select("doc_id", "n_words", "n_removed", "text").collect()
    # rows of no id have no order among groups: compared by what they lose together
    named = lambda rows: order(r for r in map(tuple, rows) if r[0] is not None)
    want = brute_substring([tuple(r) for r in docs.collect()], window)
    assert [(a, b, c, d or "") for a, b, c, d in named(got)] == named(want)
    assert sum(r[2] for r in got) > 0


def test_substring_repeated_and_string_ids(spark):
    """Different texts of one id, in different groups, go by the hash of their text; ids may be strings or null."""
    from pyspark.sql import functions as F

    r = random.Random(21)
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(i % 9 if i % 10 else None, " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 30))) + " " + shared * (i % 3 > 0) + f" tail{i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for kind in ("bigint", "string"):
        named = d.withColumn("doc_id", F.col("doc_id").cast(kind))
        hashes = {(x.doc_id, x.text): x.h for x in named.select("*", F.xxhash64("text").alias("h")).collect()}
        seen, want = set(), []
        for (i, t), _ in sorted(hashes.items(), key=lambda x: (x[0][0] is None, x[0][0] or ("" if kind == "string" else 0), x[1])):
            w = t.split()
            gone = [False] * len(w)
            for k in range(len(w) - 19):
                if (key := tuple(w[k : k + 20])) in seen:
                    gone[k : k + 20] = [True] * 20
                seen.add(key)
            want.append((i, " ".join(x for x, g in zip(w, gone) if not g)))
        got = [(x.doc_id, x.text) for x in substring.dedup(named, unchanged=False, group_bytes=300).collect()]
        assert order(got) == order(want) and any("s5" not in t for _, t in got)


def test_substring_sketch():
    """Merged counters are never below a window's count, whatever the parts; rows differ."""
    import numpy as np

    r = np.random.default_rng(3)
    parts = [r.integers(0, 2000, 150).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(5)]
    seen = defaultdict(int)
    for p in parts:
        for h in p.tolist():
            seen[h] += 1
    flagged = []
    for row in range(substring.DEPTH):
        total = substring.Sketch(9)
        for p in parts:
            total.add(*substring.once_and_more(substring.cells_of(p, row, 9)))
        flagged.append({h: bool(total.repeated(substring.cells_of(np.array([h], np.uint64), row, 9))[0]) for h in seen})
    assert all(f[h] for f in flagged for h, n in seen.items() if n > 1)
    both = sum(all(f[h] for f in flagged) for h, n in seen.items() if n == 1)
    assert both < min(sum(f[h] for h, n in seen.items() if n == 1) for f in flagged)


def test_substring_edges(crowded, nothing):
    assert substring.dedup(nothing).count() == 0
    out = substring.remove(crowded, window=4)
    assert out.columns == crowded.columns and out.count() == crowded.count()


# --- simhash


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not w:
        return 0
    sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f, least.get(find(k))) for k, ((i, _), f) in enumerate(zip(rows, fps))]


def test_simhash(docs):
    got = simhash.cluster(docs).select("id", "fp", "component").collect()
    assert order((i, f % 2**64, c) for i, f, c in got) == order(brute_components([tuple(r) for r in docs.collect()]))


def test_simhash_top_bit():
    """Fingerprints that differ in bit 63 and 1 to 3 other bits, alone and among others, against brute force."""
    import numpy as np

    r = random.Random(63)
    pairs = [(x, x ^ 1 << 63 ^ sum(1 << b for b in r.sample(range(63), k))) for k in (1, 2, 3) for x in [r.getrandbits(64) for _ in range(20)]]
    for some in [*pairs, [x for p in pairs for x in p]]:
        values = np.array(sorted(set(some)), np.uint64).view(np.int64)
        near = lambda a, b: bin((int(a) ^ int(b)) & 2**64 - 1).count("1") <= 4
        want = []
        for v in values:
            seen, todo = {int(v)}, [v]
            while todo:
                a = todo.pop()
                new = [b for b in values if int(b) not in seen and near(a, b)]
                seen |= set(map(int, new))
                todo += new
            want.append(min(seen))
        assert simhash.smallest_linked(values).tolist() == want


def test_simhash_positions():
    """Any positions that reach the minimum hold an indexed set of them; for four of eight, sets of three suffice, fewer than all."""
    from itertools import combinations

    for least in range(1, 9):
        sets = simhash.positions(least)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), least))
    assert len(simhash.positions(4)) == 20 and {len(s) for s in simhash.positions(4)} == {3}


def test_simhash_count_filter(spark):
    """Pairs that meet in a posting list but share only three positional bytes are dropped by their tally; with four, bits decide."""
    import numpy as np

    def flip(x, at, n=1):
        return x ^ sum((2**n - 1) << 8 * k for k in at)

    base = 0x0123456789ABCDEF
    fps = [base, flip(base, range(3, 8)), flip(base, range(4, 8)), flip(base, range(4, 8), 2)]
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp bigint")
    met = {frozenset(r.fps) for r in simhash._meetings(simhash.posted(df), ["fp"], 100).collect()}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    assert all(any({signed[0], x} <= m for m in met) for x in signed[1:])
    own = np.array(fps, np.uint64)
    assert simhash.tally(own[:1] ^ own[1:]).tolist() == [3, 4, 4]
    assert simhash.linked(own[:1], own[1:]).tolist() == [False, True, False]
    assert [set(r) for r in simhash.links(df).collect() if signed[1] in r] == []


def test_simhash_blocks(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    some = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 4))) for b in base for _ in range(40)}
    fps = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in some], "fp bigint")
    whole, cut = (order(simhash.components(simhash.links(fps, block=b)).collect()) for b in (32768, 3))
    assert whole == cut and whole


def test_one_of_each(spark, docs, crowded, nothing):
    left = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    comps = {(i, f): c for i, f, c in brute_components([tuple(r) for r in docs.collect()])}
    by = defaultdict(list)
    for i, t in left:
        by[comps[i, brute_fingerprint(t)]].append(i)
    assert {c for c in by if c is not None} == {c for c in comps.values() if c is not None}
    assert all(ids == [c] for c, ids in by.items() if c is not None)
    # a text without an id that nothing is linked to stays
    assert sum(i is None for i, _ in left) == sum(c is None for c in comps.values())
    assert simhash.one_of_each(nothing).count() == 0
    assert simhash.one_of_each(crowded).columns == crowded.columns


def near_copies(seed: int) -> list[tuple]:
    """Texts of 5 to 150 words with copies in which 0 to 5 words are others, chains of them, and texts without words."""
    r = random.Random(seed)
    out = []
    for i in range(90):
        words = r.choice(out)[1].split() if out and i % 3 else [r.choice(WORDS) + str(r.randrange(90)) for _ in range(r.randrange(5, 150))]
        for _ in range(r.randrange(6) if i % 3 else 0):
            words[r.randrange(len(words))] = f"new{i}"
        out.append((i, " ".join(words)))
    return [*out, (900, None), (901, ""), (902, " \n "), (None, out[0][1]), (903, out[0][1].upper())]


@pytest.mark.parametrize("block", [simhash.BLOCK_WIDE, 3])
def test_alike(spark, nothing, block, monkeypatch):
    """Components of all pairs with a Jaccard likeness of 0.8 at least on five-word shingles, also with blocks; the pipeline's stage keeps one of each."""
    import corpus_pipeline

    monkeypatch.setattr(simhash.alike_links, "__defaults__", (*simhash.alike_links.__defaults__[:-1], block))
    rows = near_copies(8)
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in ((t or "").lower().split() for _, t in rows)]
    near = lambda a, b: len(a & b) / len(a | b) >= 0.8
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near(sets[a], sets[b]) and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    least = {}
    for (i, _), x in zip(rows, root):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    assert 20 < len(least) < len(rows) - 10
    assert order(tuple(r) for r in simhash.alike(d).select("id", "component").collect()) == order((i, least[x]) for (i, _), x in zip(rows, root))
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, d, "").collect()} == set(least.values())
    assert simhash.alike(nothing).count() == 0


def test_wide_fingerprint_is_a_simhash():
    """Each bit by the majority of votes; pairs at the least likeness (nested or not, few shingles or many) share a key and pass both filters."""
    words = [f"w{k % 37}" for k in range(300)]
    hashes = {xxhash.xxh64_intdigest(" ".join(words[k : k + 5]), 42) for k in range(296)}
    total = simhash.votes(np.array(sorted(hashes), np.uint64)).sum(axis=0, dtype=int)
    assert np.unpackbits(np.frombuffer(simhash.wide_fingerprint(" ".join(words)), np.uint8)).tolist() == (2 * total > simhash.VOTES * len(hashes)).tolist()
    r = np.random.default_rng(5)
    for a, b, c in [(4, 0, 1), (8, 0, 2), (40, 0, 10), (8, 1, 1), (72, 9, 9)] * 30:
        h = r.integers(0, 2**64, a + b + c, dtype=np.uint64)
        x, y = (np.packbits(2 * simhash.votes(s).sum(axis=0, dtype=int) > simhash.VOTES * len(s)) for s in (h[: a + b], np.concatenate([h[:a], h[a + b :]])))
        assert (x.reshape(-1, simhash.KEY) == y.reshape(-1, simhash.KEY)).all(axis=1).any() and (x == y).sum() >= simhash.SAME
        assert np.bitwise_count(x[: simhash.CHECK] ^ y[: simhash.CHECK]).sum() <= simhash.NEAR


@pytest.mark.parametrize("short", [simhash.SHORT, 3])
def test_smallest_near(short, monkeypatch):
    """Each list's components of pairs within NEAR bits, in short lists and long ones, against brute force."""
    monkeypatch.setattr(simhash, "SHORT", short)
    r = np.random.default_rng(2)
    sizes = np.array([2, 1, 300, 257, 40])
    ids = r.permutation(5000)[: sizes.sum()].astype(np.int64)
    check = r.integers(0, 2**64, (40, 2), dtype=np.uint64)[r.integers(0, 40, len(ids))]
    for row in check:
        for k in r.integers(0, 128, r.integers(0, 30)).tolist():
            row[k // 64] ^= np.uint64(1 << k % 64)
    want, moved = ids.copy(), True
    at = np.repeat(np.arange(len(sizes)), sizes)
    near = (np.bitwise_count(check[:, None] ^ check[None]).sum(axis=2) <= simhash.NEAR) & (at[:, None] == at[None])
    while moved:
        new = np.where(near, want[None], 2**62).min(axis=1)
        moved, want = (new != want).any(), new
    assert simhash.smallest_near(ids, check, sizes).tolist() == want.tolist() and (want != ids).sum() > 100


def test_components_of_dense_groups(spark, monkeypatch):
    """Groups whose entries meet in nearly every list, alone and in chains: the rounds join about one edge a vertex; components are those of all edges."""
    r = np.random.default_rng(9)
    rows = []
    for base in r.integers(0, 256, (2, simhash.WIDE), dtype=np.uint8):
        flips = np.packbits(r.random((150, 8 * simhash.WIDE)) < 0.08, axis=1)
        rows += [(int(h), bytes(x)) for h, x in zip(r.integers(-(2**62), 2**62, 150), base ^ flips, strict=True)]
    edges = simhash.near_links(spark.createDataFrame(rows, "hash bigint, wide binary"))
    chain = [(k, k + 1) for k in range(2**62, 2**62 + 20)]
    pairs = [(x.fp, x.other) for x in edges.collect()] + chain + [(b, a) for a, b in chain[:5]]
    root = {v: v for e in pairs for v in e}
    assert len(pairs) > 8 * len(root)
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
    written, write = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    got = simhash.components(spark.createDataFrame(pairs, "fp bigint, other bigint")).collect()
    assert order(got) == order(root.items()) and len(set(root.values())) == 3
    # of the tables of edges the last is what the rounds join: every edge in both directions
    joined = [df for df in written if df.columns == ["fp", "other"]][-1].count()
    assert joined <= 4 * len(root)
    assert simhash.components(edges.limit(0)).count() == 0


# --- decontamination


def brute_hits(text, items, window=10):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())
    w = find(text)
    hit, names = set(), set()
    for name, t in items:
        v = find(t)
        n = min(window, len(v))
        for win in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == win:
                    hit.update(range(k, k + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("max_words", [1_000_000, 25])
def test_decontaminate(spark, docs, max_words):
    texts = [t for _, t in map(tuple, docs.collect()) if t]
    items = [(1, texts[0]), (2, " ".join(texts[3].split()[:25])), (3, "the1"), (4, None), (5, ""), (6, " ".join(texts[5].split()[2:6])), (7, texts[0]), (8, "one two UNSEEN words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.find(docs, bench, max_words=max_words).collect()
    for r in got:
        assert (r.n_words, sum(b - a for a, b in r.hit_spans), r.hit_items) == brute_hits(r.text, items)
    assert any(r.hit_items for r in got)


def test_decontaminate_removes(spark, crowded, nothing):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta eps zeta eta theta iota kappa")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "start here, " * 12 + "Alpha beta; gamma delta eps zeta eta theta iota kappa end", 9), (2, "alpha beta gamma delta eps zeta eta theta iota kappa", 9), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: r for r in decontam.remove(d, bench, n_chars="n_chars").collect()}
    assert set(out) == {1, 3} and "gamma" not in out[1].text and out[1].text.endswith("end") and out[1].n_chars == len(out[1].text)
    assert decontam.remove(nothing, bench).count() == 0
    # a benchmark of several automata, each in a pass of its own, beside one of all items
    two = bench.unionByName(spark.createDataFrame([(2, "zeta eta"), (3, "start here"), (4, "alpha beta")], bench.schema))
    for some in (d, crowded):
        whole, parts = (order(decontam.remove(some, two, n_chars="n_chars", max_words=m).collect()) for m in (1000, 4))
        assert whole == parts
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.remove(crowded, empty).count() == crowded.count()
    assert decontam.remove(crowded, bench).columns == crowded.columns


# --- BPE


def test_bpe(spark, docs, crowded, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    tok = pytest.importorskip("public_tokenizers")
    path = tok.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["  two  spaces ", " lead", "trail ", "a b 　 c", "don't we'll 12345 ...!!!", "日本語 emoji 🎉🎉", "x" * 3000, "ab" * 700 + " " + "é" * 500, "\n\n\t a", "<|endoftext|>", "\0 \x7f"]
    more = docs.unionByName(spark.createDataFrame(list(enumerate(odd, 500)), "doc_id bigint, text string"))
    for r in bpe.encode(more, path, tok.PATTERN, decoded="back").collect():
        assert memoryview(r.ids).cast("I").tolist() == own.encode_ordinary(r.text or "")
        assert bytes(r.back).decode() == (r.text or "")
    assert bpe.encode(nothing, path, tok.PATTERN).count() == 0
    assert bpe.decode(bpe.encode(crowded, path, tok.PATTERN), path).count() == crowded.count()


@pytest.mark.parametrize("many", [1, 5, 100])
def test_bpe_replay(many, monkeypatch):
    """All words go through the index of pairs, as arrays or one by one; ids are a greedy encoder's, also where a merge opens a pair of lower rank."""
    monkeypatch.setattr(bpe, "MANY", many)
    r = random.Random(many)
    # few letters, and tokens ranked at random, so that ranks don't grow with length
    some = {bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6))) for _ in range(150)}
    tokens = [bytes([k]) for k in range(256)] + r.sample(sorted(some), len(some))
    ranks = {t: k for k, t in enumerate(tokens)}

    def greedy(word):
        parts = [bytes([c]) for c in word]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    words = [bytes(r.choice(b"aabcd") for _ in range(r.randrange(1, 40))) for _ in range(400)] + [b"a" * 200, b"ab" * 90]
    got = bpe.replay(words, bpe.Merges(ranks))
    assert [memoryview(g).cast("I").tolist() for g in got] == [greedy(w) for w in words]
    assert bpe.replay([], bpe.Merges(ranks)) == []


# --- Merkle trees


def brute_tree(text):
    """Root digest and the leaves' texts by section and paragraph, by splitting lines and words one at a time."""
    b2 = lambda parts, kind=b"": hashlib.blake2b(b"".join(parts), digest_size=16, person=kind).digest()
    lines = re.split(r"(?<=\n)", text)
    sections = [[]]
    for k, line in enumerate(x for x in lines if x):
        blank = not line.strip(" \t\r\n") and line.endswith("\n")
        if sections[-1] and not blank and sections[-1][-1][1] and k:
            sections.append([])
        sections[-1].append((line, blank and len(sections[-1]) > 0))
    out = []
    for section in sections:
        ps = []
        for line, _ in section:
            pieces, at = [], 0
            while at < len(line):
                begin, words = at, 0
                if line[at].isspace():
                    while at < len(line) and line[at].isspace():
                        at += 1
                else:
                    while words < merkle.PIECE and at < len(line) and not line[at].isspace() and line[at] not in ".!?":
                        while at < len(line) and not line[at].isspace() and line[at] not in ".!?":
                            at += 1
                        while at < len(line) and line[at].isspace() and line[at] != "\n":
                            at += 1
                        words += 1
                    while at < len(line) and line[at] in ".!?":
                        at += 1
                    while at < len(line) and line[at].isspace():
                        at += 1
                pieces.append(line[begin:at])
            ps.append(pieces)
        if ps:
            out.append(ps)
    digest = lambda pieces: [b2([p.encode()]) for p in pieces]
    return b2([b2([b2(digest(p), b"paragraph") for p in s], b"section") for s in out], b"document"), out


def brute_likeness(a, b):
    from collections import Counter

    bag = lambda t: Counter(x for s in brute_tree(t)[1] for p in s for x in p)
    both = sum(len(x) * n for x, n in (bag(a) & bag(b)).items())
    return 2 * both / (len(a) + len(b)) if a or b else 1.0


TREES = ["", "One two three. Four five six!\nSecond line here\n\nNew section\twith words.\n\n\n", "  lead\n\n \nx", "a b c d e f g", "...!? a.b  c\n", "x " * 5000 + "\n" * 50 + "tail", "same same same same same same\n\nsame same same", "é ü 日本. ok"]


def test_merkle_tree():
    for t in TREES:
        root, n, made = merkle.tree(t)
        assert n == len(t) == sum(leaf[1] for s in made for p in s[2] for leaf in p[2])
        assert root == brute_tree(t)[0]
        assert (merkle.tree(t + " ")[0] == root) is False
    assert merkle.tree(None) == merkle.tree("")


def test_merkle_branches():
    """Descending differing branches finds the common characters that comparing all leaves finds, and the edits."""
    r = random.Random(6)
    some = [*TREES, *(" ".join(r.choice("ab cd. ef\n gh\n\n ij".split(" ")) for _ in range(r.randrange(60))) for _ in range(30))]
    for a in some:
        for b in some:
            x, y = merkle.tree(a), merkle.tree(b)
            assert abs(merkle.likeness(x, y) - brute_likeness(a, b)) < 1e-12
            common, leaves = merkle.descend(x, y)
            assert merkle.compared(x, y) == (common, len(leaves))
    t = TREES[1]
    assert merkle.descend(merkle.tree(t), merkle.tree(t)) == (len(t), [])
    assert merkle.descend(merkle.tree(t), merkle.tree(t.replace("with", "without")))[1] == [(1, 0, 0)]
    assert merkle.descend(merkle.tree(""), merkle.tree("a b"))[1] == [(0, 0, 0)]


@pytest.mark.parametrize("range_bytes", [8_000_000, 300])
def test_merkle_next(spark, docs, crowded, nothing, range_bytes, monkeypatch):
    """All columns of the query against brute force, with ranges that hold one document or none."""
    monkeypatch.setattr(merkle, "RANGE_BYTES", range_bytes)
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in named.collect())
    out = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_changed bigint"
    got = {r.doc_id: r for r in merkle.with_next(named, merkle._Seen(), out).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (brute_tree(t)[0].hex(), brute_tree(edited)[0].hex())
        assert abs(got[i].near_edited - brute_likeness(t, edited)) < 1e-12 and abs(got[i].near_next - brute_likeness(t, nxt)) < 1e-12
    for d in (docs, crowded):  # repeated, null and clashing
        assert sorted(r.doc_id is None for r in merkle.with_next(d, merkle._Seen(), out).collect()) == sorted(r.doc_id is None for r in d.collect())
    assert merkle.with_next(nothing, merkle._Seen(), out).count() == 0
    one = spark.createDataFrame([(5, "alone here")], "doc_id bigint, text string")
    assert [(r.doc_id, r.near_next) for r in merkle.with_next(one, merkle._Seen(), out).collect()] == [(5, 1.0)]


# --- language


def test_language(spark, nothing, crowded):
    r = random.Random(5)
    says = {"aa": "kala mina sopu tera luvo", "bb": "zwicht ächtel brumpf schnorz glück", "cc": "ñandu queso llamo españ ciono"}
    rows = [(k, " ".join(r.choice(says[l].split()) for _ in range(25)), l) for k, l in enumerate(["aa", "bb", "cc"] * 40)]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !!", "bb"), (None, "kala mina", None)], "doc_id bigint, text string, lang string")
    model = language.fit(d.where("doc_id < 60"))
    got = {x.doc_id: x for x in language.predict(d, model).collect()}
    assert all(got[k].lang_pred == l for k, _, l in rows) and all(0 <= x.score <= 1 for x in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert language.predict(nothing, model).count() == 0
    assert language.predict(crowded, model).count() == crowded.count()
    untaught = language.fit(d.limit(0))
    assert {x.lang_pred for x in language.predict(d, untaught).collect()} == {"und"}


def test_language_lengths_are_those_of_the_tree():
    """The tabulated code lengths against a walk down a tree of contexts."""
    import numpy as np

    texts = ["abra cadabra abra", "banana bandana"]
    counts, seen = {}, defaultdict(lambda: defaultdict(int))
    for k, keys, n in language._count(texts, 2):
        counts["x", k] = (keys, n)
    for t in map(language.normal, texts):
        for p in range(len(t)):
            for k in range(min(p, 2) + 1):
                seen[t[p - k : p]][t[p]] += 1

    def length(context, byte):
        own = seen.get(context)
        below = np.log(256.0) if not context else length(context[1:], byte)
        if own is None:
            return below
        n, d = sum(own.values()), len(own)
        return np.log((n + d) / own[byte]) if byte in own else np.log((n + d) / d) + below

    model = language.Model(["x"], counts, 2)
    for t in (b" abra ", b" zzz ", b" bandabra ", b" q "):
        want = sum(length(t[max(0, p - 2) : p], t[p]) for p in range(len(t)))
        assert abs(model.code_lengths([t])[0, 0] - want) < 1e-3


# --- quality


def test_quality(spark, nothing, crowded):
    r = random.Random(9)
    line = lambda k, bad: " ".join(r.choice(WORDS) for _ in range(k)) + (" vile" if bad == 0 else " | " * 30 if bad == 1 else "")
    rows = [(k, line(30, k % 3), k % 3) for k in range(600)]
    d = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9000, None), (None, "")], "doc_id bigint, text string")
    rated = spark.createDataFrame([(k, g) for k, _, g in rows if k < 300] + [(None, 1), (5, None)], "id bigint, grade int")
    model = quality.fit(d, rated, 3)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    got = {x.doc_id: x for x in quality.score(d, model).collect()}
    right = sum(got[k].keep == (g == 2) for k, _, g in rows if k >= 300)
    assert right >= 0.97 * 300 and all(0 <= x.tail_probability <= 1 and 0 <= x.expected_grade <= 2 for x in got.values())
    assert quality.score(nothing, model).count() == 0
    assert quality.score(crowded, model, only_kept=True).columns == crowded.columns
    assert quality.score(crowded, quality.fit(d, rated.limit(0), 3)).where("not keep").count() == 0


# --- hosts


def test_hosts(spark):
    rows = [(k, u) for k, u in enumerate(["http://a.example.com/en/x", "https://www.example.com/en/x", "http://WWW.Example.COM?q", "http://x.net/fr/1", "http://net/es/", "http://notexample.com/en/", None, "no scheme", "", "http://bad.org/1", "ftp://bad.org#f"])]
    pages = spark.createDataFrame([*rows, (None, "http://b.org")], "page_id bigint, url string")
    bad = spark.createDataFrame([(k, True) for k in (9, 10)] * 40 + [(k, False) for k in (0, 1, 2, 4, 5)] * 40 + [(3, False), (None, True), (777, True)], "id bigint, bad boolean")
    got = {r.page_id: r for r in hosts.judge(pages, bad).collect()}
    want = [("example.com/en/", "block"), ("www.example.com/en/", "allow"), (None, None), ("net/fr/", "block"), ("net/es/", "block"), ("com/", "allow")]
    assert [(got[k].rule, got[k].verdict) for k in (0, 1, 3, 4, 5)] == [w for w in want if w[0]]
    assert (got[2].host, got[2].path, got[6].host, got[7].path) == ("www.example.com", "", "", "")
    assert got[9].verdict == got[10].verdict == "block" and got[6].verdict == "allow"
    assert len(got) == len(rows) + 1
    assert hosts.judge(pages.limit(0), bad).count() == 0 and hosts.judge(pages, bad.limit(0)).count() == len(got)


def test_hosts_domains(spark):
    """Public suffixes, ports, users and addresses; a url's host keeps its port."""
    from pyspark.sql import functions as F

    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("x.com", "com"), "a.x.com": ("x.com", "com"), "com": ("com", "com"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "[::1]": ("[::1]", "[::1]"), "": ("", ""), "1.2.3.4.org": ("4.org", "org")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.domain, r.suffix) for r in hosts.with_domain(df).collect()} == want
    assert {r.host: r.suffix for r in hosts.with_domain(df, ()).collect()}["a.b.co.uk"] == "uk"
    sites = spark.createDataFrame([("u:p@a.org:80",), ("a.org:",), ("a.org",)], "h string").select(hosts.site(F.col("h")).alias("s"))
    assert {r.s for r in sites.collect()} == {"a.org"}


def test_hosts_posterior(spark):
    """The posterior's probability beside sampling and closed forms."""
    import numpy as np
    from pyspark.sql import functions as F

    some = [(1.0, 1.0), (0.02, 3.0), (3.0, 0.02), (5.0, 2.0), (400.0, 380.0), (30000.0, 29500.0), (1e-5, 1.0)]
    df = spark.createDataFrame(some, "a double, b double").withColumn("p", hosts.below(F.col("a"), F.col("b"), 0.5))
    r = np.random.default_rng(1)
    for row in df.collect():
        assert abs(row.p - (r.beta(row.a, row.b, 400_000) <= 0.5).mean()) < 4e-3, row
    for limit in (0.1, 0.5, 0.9):
        [got] = spark.createDataFrame([(2.0, 1.0)], "a double, b double").select(hosts.below(F.col("a"), F.col("b"), limit).alias("p")).collect()
        assert abs(got.p - limit**2) < 1e-3


def test_hosts_clashing_names_and_salt(spark, monkeypatch):
    rows = [(k, f"http://h{k % 7}.org/{k}", "x", "x", "x", "x") for k in range(70)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, rule string, site string")
    bad = spark.createDataFrame([(k, k % 7 == 3) for k in range(70)], "id bigint, bad boolean")
    want = order(hosts.judge(pages, bad).collect())
    assert {r[4] for r in want if "h3." in r[1]} == {"block"} and {r[4] for r in want if "h3." not in r[1]} == {"allow"}
    monkeypatch.setattr(_util, "BROADCAST", 0)
    assert order(hosts.judge(pages, bad).collect()) == want


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="single with-sidebar"><header><p>Site name</p></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="wrap"><%s><h1>Title &amp; more</h1><p>First   para <b>bold</b>&nbsp;end.<br>same block<p>Second %s &lt;b&gt; para with some more words in it, so that it is long enough.</p>
<div class="ad">Buy</div><aside>Aside</aside><form>Name <input></form><ul><li>One</li><li>Two</li></ul></%s><div class="sidebar"><p>Popular posts</p></div><section id="comments"><h3>Comments</h3><p>I am a reader comment of some length, really.</p></section></div><footer>&copy; me</footer></body></html>"""
MAIN = "Title & more\nFirst para bold end. same block\nSecond %s <b> para with some more words in it, so that it is long enough.\nOne\nTwo"


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_template(spark, element):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE % (element, f"w{k}", element)) for k in range(12)]
    pages = spark.createDataFrame([*rows, (50, None, PAGE % (element, "x", element)), (51, "http://h0.org/n", None), (52, "u", ""), (53, "http://h0.org/bare", "just text"), (54, "http://h0.org", "<p>open <b>unclosed"), (55, "http://h1.org", "< not a tag > & x"), (None, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in template.extract(pages).collect()}
    assert all(got[k] == MAIN % f"w{k}" for k in range(12)) and got[50] == MAIN % "x"
    assert (got[51], got[52], got[53], got[54], got[None]) == ("", "", "just text", "open unclosed", "")
    assert template.extract(pages.limit(0)).count() == 0


def test_template_keeps_copies(spark):
    """Pages that are copies of one another are no template."""
    same = PAGE % ("article", "w", "article")
    pages = spark.createDataFrame([(k, "http://h.org/a", same) for k in range(30)], "page_id bigint, url string, html string")
    assert {r.text for r in template.extract(pages).collect()} == {MAIN % "w"}


def test_template_drops_fixed_text(spark):
    """A block that stands once on every page of a host, and is little of them, is template text."""
    html = "<html><body><article><p>%s</p><p>Sign up for our letter</p></article></body></html>"
    pages = spark.createDataFrame([(k, "http://h.org/a", html % (f"story {k} " * 30)) for k in range(8)], "page_id bigint, url string, html string")
    assert {r.text for r in template.extract(pages).collect()} == {(f"story {k} " * 30).strip() for k in range(8)}


def test_template_drops_fixed_text_with_odd_pages(spark):
    """Empty pages, one of another layout and one that lacks the text don't keep it on the others."""
    html = "<html><body><article><p>%s</p><p>Sign up for our letter</p></article></body></html>"
    odd = [(20, "http://h.org/a", None), (21, "http://h.org/b", ""), (22, "http://h.org/c", "<html><body><div><p>Not found</p></div></body></html>"), (23, "http://h.org/d", "<html><body><article><p>bare</p></article></body></html>")]
    pages = spark.createDataFrame([*((k, "http://h.org/a", html % (f"story {k} " * 30)) for k in range(8)), *odd], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in template.extract(pages).collect()}
    assert [got[k] for k in range(8)] == [(f"story {k} " * 30).strip() for k in range(8)]
    assert [got[k] for k in range(20, 24)] == ["", "", "Not found", "bare"]


def test_template_copies_do_not_cancel(spark):
    """A page alone in its batch keeps its text, though all others of its host come in pairs of equal ones."""
    html = "<html><body><article><p>%s</p></article></body></html>"
    texts = [(f"story {k} " * 30).strip() for k in "abbcc"]
    pages = spark.createDataFrame([(k, "http://h.org/a", html % t) for k, t in enumerate(texts)], "page_id bigint, url string, html string")
    assert pages.rdd.mapPartitions(lambda rows: [[r.page_id for r in rows]]).first() == [0]
    assert {r.page_id: r.text for r in template.extract(pages).collect()} == dict(enumerate(texts))


# --- WARC


def test_warc(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    big = "x\r\n\r\nWARC/1.1\r\n" * 3000 + "ÿ€"
    rows = [(1, "http://b.org/2", "one"), (2, "http://a.b.org/1", "one"), (7, None, "one"), (3, "http://a.b.org/1?x\ty", ""), (4, "odd url", None), (5, "http://c.org", big), (9, "http://z.org/", "two"), (9, "http://z.org/", "two"), (None, "http://n.org", "two"), (None, "http://n.org", "alone")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    plain = order(warc.records(pages).collect())
    warc.write(warc.records(pages.coalesce(2)), f"file://{tmp_path}/a", file_bytes=700)
    caps = warc.captures(spark, f"file://{tmp_path}/a")
    assert caps.select("file").distinct().count() > 2
    warc.build_index(caps, f"file://{tmp_path}/i", block=2)
    looked = warc.look_up(spark, f"file://{tmp_path}/i", pages.select("url", F.col("page_id").alias("id")))
    assert order(looked.collect()) == order(caps.collect())
    read = warc.read_records(spark, f"file://{tmp_path}/a", looked)
    got = order(read.select("id", "bytes", "digest", "kind", "refers_to").collect())
    bodies = {(r.id, bytes(r.payload).decode()) for r in read.where("kind = 'response'").collect()}
    assert bodies == {(i, h or "") for i, _, h in rows if (i, h) not in ((1, "one"), (2, "one"), (3, ""), (None, "two"))}
    some = warc.look_up(spark, f"file://{tmp_path}/i", pages.where("page_id in (5, 9)").select("url", F.col("page_id").alias("id")))
    assert sorted(r.id for r in some.collect()) == [5, 9, 9]
    # a store that Spark alone can read: whole files instead of ranges
    monkeypatch.setattr(warc, "open_store", lambda path: (_ for _ in ()).throw(OSError(path)))
    assert order(warc.read_records(spark, f"file://{tmp_path}/a", looked).collect()) == order(read.collect())
    monkeypatch.setattr(_util, "BROADCAST", 0)
    assert order(warc.records(pages).collect()) == plain
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b, t = (h or "").encode(), top.get(h or "")
        later = t is not None and i != t
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if later else "response", t if later else None))
    assert got == order(want)
    d = warc.Directory(spark, f"file://{tmp_path}/i")
    assert len(d.first) > 1
    [line] = d.captures(spark, "http://c.org")
    assert warc.fetch(spark, f"file://{tmp_path}/a", line).decode() == big
    assert [x[1] for x in d.captures(spark, "http://a.b.org/1")] == ["2"] and d.captures(spark, "http://none.org") == []
    small = warc.records(pages, min_bytes=4).where("kind = 'revisit'").count()
    assert small == 0
    warc.write(warc.records(pages.limit(0)), f"file://{tmp_path}/e")
    assert warc.captures(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_files_stay_out_of_the_jvm(spark, tmp_path, monkeypatch):
    """The index is made from files read in pieces, as well as from whole ones; records come without payloads where these aren't wanted, and are still held against their digests."""
    from pyspark.sql import functions as F

    rows = [(k, f"http://h.org/{k}", f"text {k % 7} " * (k * 40)) for k in range(30)]
    warc.write(warc.records(spark.createDataFrame(rows, "page_id bigint, url string, html string")), f"file://{tmp_path}/a", file_bytes=700)
    caps = warc.captures(spark, f"file://{tmp_path}/a")
    assert "content:binary" not in caps._jdf.queryExecution().executedPlan().toString()
    read = warc.read_records(spark, f"file://{tmp_path}/a", caps)
    short = warc.read_records(spark, f"file://{tmp_path}/a", caps, payload=False)
    assert order(short.collect()) == order(read.drop("payload").collect()) and short.count() == 30
    warc.write(warc.records(spark.createDataFrame(rows, "page_id bigint, url string, html string")).withColumn("digest", F.lit("0" * 40)), f"file://{tmp_path}/b")
    with pytest.raises(Exception, match="match its digest"):
        warc.read_records(spark, f"file://{tmp_path}/b", warc.captures(spark, f"file://{tmp_path}/b"), payload=False).collect()
    want = order(caps.collect())
    monkeypatch.setattr(warc, "open_store", lambda path: (_ for _ in ()).throw(OSError(path)))
    assert order(warc.captures(spark, f"file://{tmp_path}/a").collect()) == want

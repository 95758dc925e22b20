"""The registered queries' columns, and the pipeline's stages, over the smallest tables beside independent versions."""

import base64
import hashlib
import math
import re
from collections import defaultdict
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pytest
import xxhash

import corpus_pipeline as P
from descmap.llm import language, quality, queries

SF = "/root/testdata/sf0.001"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def ascii_lower(text):
    return (text or "").encode().translate(LOWER)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- versions


def hit_words(text, items, window=10):
    """Words of a text, the places that benchmark windows cover, and the items they are of."""
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    of = defaultdict(set)
    for i, t in items:
        v = find(t)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            of[tuple(v[k : k + n])].add(str(i))
    w = find(text)
    hit, names = set(), set()
    for n in {len(k) for k in of}:
        for k in range(len(w) - n + 1):
            if got := of.get(tuple(w[k : k + n])):
                hit.update(range(k, k + n))
                names |= got
    return w, hit, names


def kept_words(texts, window=20):
    """By id: words, and whether each is kept."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if (key := tuple(w[k : k + window])) in seen:
                keep[k : k + window] = [False] * window
            seen.add(key)
        out[i] = w, keep
    return out


def smallest(ids, near):
    least = {i: i for i in ids}
    for i in sorted(ids):
        if least[i] != i:
            continue
        todo = [i]
        while todo:
            a = todo.pop()
            for b in ids:
                if least[b] == b and b > i and near(a, b):
                    least[b] = i
                    todo.append(b)
    return least


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower(text))
    return [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []


# --- queries


def test_op1(spark, docs):
    """Languages and scores from trees of contexts in dictionaries."""
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for r in rows:
        if r.lang is not None and crc32(str(r.doc_id).encode()) % 3 != 1 and r.text:
            t = language.normal(r.text)
            for p in range(len(t)):
                for k in range(min(p, language.ORDER) + 1):
                    counts[r.lang][t[p - k : p]][t[p]] += 1

    def nats(tree, context, byte):
        total = 0.0
        while context is not None:
            if own := tree.get(context):
                n, d = sum(own.values()), len(own)
                if byte in own:
                    return total + math.log((n + d) / own[byte])
                total += math.log((n + d) / d)
            context = context[1:] if context else None
        return total + math.log(256)

    got = {r.doc_id: r for r in run(spark, "op1_language")}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert got[i].held_out == (crc32(str(i).encode()) % 3 == 1)
    for i in sorted(docs, key=lambda i: len(docs[i] or ""))[:60]:
        t = language.normal(docs[i] or "")
        if not t:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cost = {l: sum(nats(tree, t[max(0, p - language.ORDER) : p], t[p]) for p in range(len(t))) for l, tree in counts.items()}
        best = min(sorted(cost), key=cost.__getitem__)
        assert got[i].lang_pred == best
        assert abs(got[i].score - 1 / sum(math.exp(cost[best] - c) for c in cost.values())) < 1e-2


class Article(HTMLParser):
    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "article", "div", "section", "table", "tr"}

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.blocks = 0, [], []
        self.feed(source)
        self.end()

    def end(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.end()
        self.inside += tag == "article"
        if tag == "br" and self.inside:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_op2(spark, pages):
    """The tables' pages have one article each: its blocks by the standard library's parser."""
    got = {r.page_id: r for r in run(spark, "op2_template")}
    assert set(got) == set(pages)
    for i, (url, html) in pages.items():
        want = "\n".join(Article(html or "").blocks)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


def test_op3(spark, docs):
    """Grades from the fitted weights, one feature and one threshold at a time."""
    got = {r.doc_id: r for r in run(spark, "op3_quality")}
    assert set(got) == set(docs)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(table, quality.ratings(spark.read.parquet(f"{SF}/labels.parquet")), 3)
    for i, t in docs.items():
        s = sum(float(model.weights[h]) for h in {quality.hashed(f) for f in quality.features(t or "")})
        tails = [1 / (1 + math.exp(c - s)) for c in model.thresholds]
        assert abs(got[i].expected_grade - sum(tails)) < 1e-6 and abs(got[i].tail_probability - tails[1]) < 1e-6 and got[i].keep == (tails[1] >= 0.5)


def test_op3_likelihood():
    """Probabilities of grades from their definition, and the gradient by differences."""
    r = np.random.default_rng(5)
    n, d, grades = 40, 6, r.integers(0, 4, 40)
    of = np.repeat(np.arange(n), 3)
    col = r.integers(0, d, 3 * n)
    par = np.concatenate([r.normal(size=d), [-0.3, 0.1, -0.5]])

    def value(q):
        t = [q[d]]
        for step in q[d + 1 :]:
            t.append(t[-1] + math.exp(step))
        total = 0.0
        for k in range(n):
            s = sum(q[c] for c, o in zip(col, of) if o == k)
            at_least = [1.0, *(1 / (1 + math.exp(x - s)) for x in t), 0.0]
            total -= math.log(at_least[grades[k]] - at_least[grades[k] + 1])
        return total / n + 0.5 * 0.01 * sum(w * w for w in q[:d])

    got, gradient = quality.likelihood(par, col, of, grades, n, d, 0.01)
    assert abs(got - value(par)) < 1e-9
    for k in range(len(par)):
        step = np.eye(len(par))[k] * 1e-5
        assert abs(gradient[k] - (value(par + step) - value(par - step)) / 2e-5) < 1e-6


def test_op3_ties_and_repeats(spark):
    """Repeated rows are scored alike; of several ratings of an id the highest counts; a very long text and clashing columns change nothing."""
    rows = [(k, "good plain words " * 4 if k % 2 else "bad bad junk | | | " * 4) for k in range(80)]
    d = spark.createDataFrame([*rows, *rows, (500, "plain " * 300_000)], "doc_id bigint, text string")
    rated = spark.createDataFrame([(k, 2 if k % 2 else 0) for k in range(80)] + [(k, 0) for k in range(80)], "id bigint, grade int")
    model = quality.fit(d, rated, 3)
    got = defaultdict(set)
    for r in quality.score(d, model).collect():
        got[r.doc_id].add((r.tail_probability, r.keep))
    assert all(len(v) == 1 for v in got.values()) and len(got) == 81
    assert all(next(iter(got[k]))[1] == bool(k % 2) for k in range(80))


def test_op1_ties_and_repeats(spark):
    rows = [(k, "kala mina sopu tera", "aa") for k in range(20)] + [(k, "kala mina sopu tera", "bb") for k in range(20)] + [(99, "tera " * 200_000, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.predict(d, language.fit(d)).collect()
    assert len(got) == 41 and {r.lang_pred for r in got} == {"aa"} and all(abs(r.score - 0.5) < 1e-6 for r in got)


def test_op5(spark, pages):
    got = {r.page_id: r for r in run(spark, "op5_warc")}
    assert set(got) == set(pages)
    top = {}
    for i, (_, h) in pages.items():
        top[h or ""] = max(top.get(h or "", i), i)
    for i, (_, h) in pages.items():
        b, t = (h or "").encode(), top[h or ""]
        assert tuple(got[i]) == (i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if t == i else "revisit", None if t == i else t)


def test_op6(spark, docs, items):
    got = {r.doc_id: r for r in run(spark, "op6_decontaminate")}
    assert set(got) == set(docs)
    for i, t in docs.items():
        w, hit, names = hit_words(t, items)
        assert tuple(got[i]) == (i, len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit))
    assert any(r.contaminated for r in got.values())


def test_op7(spark, docs):
    fps = {}
    for i, t in docs.items():
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(t, 4)], np.uint64)
        fps[i] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    least = smallest(list(docs), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    assert sorted(map(tuple, run(spark, "op7_simhash"))) == sorted((i, f"{fps[i]:016x}", least[i]) for i in docs)
    assert len(set(least.values())) < len(docs)


def test_op8(spark, docs):
    want = {i: (i, len(w), keep.count(False), sha(b" ".join(x for x, k in zip(w, keep) if k))) for i, (w, keep) in kept_words(docs).items()}
    got = {r.doc_id: tuple(r) for r in run(spark, "op8_substring")}
    assert got == want and sum(r[2] for r in got.values()) > 0


def test_op9(spark, docs):
    tiktoken, tok = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tok.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: tuple(r) for r in run(spark, "op9_bpe")}
    for i, t in docs.items():
        ids = own.encode_ordinary(t or "")
        assert got[i] == (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
    assert set(got) == set(docs)


# --- the pipeline's stages, each on its own input


def test_stage_quality(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(table, quality.ratings(spark.read.parquet(f"{SF}/labels.parquet")), 3)
    keep = {i for i, t in docs.items() if sum(float(model.weights[h]) for h in {quality.hashed(f) for f in quality.features(t or "")}) >= model.thresholds[1]}
    got = P.quality_stage(spark, table, SF).collect()
    assert {r.doc_id for r in got} == keep and all(r.text == docs[r.doc_id] for r in got)


def test_stage_near_dedup(spark, docs):
    sets = {i: frozenset(shingles(t, 5)) for i, t in docs.items()}
    least = smallest(list(docs), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = P.near_dedup_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert {r.doc_id for r in got} == set(least.values()) and len(got) < len(docs)


def test_stage_substring(spark, docs):
    got = {r.doc_id: r for r in P.substring_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    for i, (w, keep) in kept_words(docs).items():
        want = docs[i] if all(keep) else b" ".join(x for x, k in zip(w, keep) if k).decode()
        assert got[i].text == want and got[i].n_chars == len(want)


def test_stage_decontaminate(spark, docs, items):
    got = {r.doc_id: r.text for r in P.decontaminate_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for i, t in docs.items():
        w, hit, _ = hit_words(t, items)
        if len(hit) > 0.5 * len(w):
            assert i not in got
            continue
        # words that are hit go, with what stands between two of them
        spans = [m.span() for m in word.finditer(t)]
        gone = [False] * len(t)
        for k in hit:
            end = spans[k + 1][0] if k + 1 in hit else spans[k][1]
            gone[spans[k][0] : end] = [True] * (end - spans[k][0])
        assert got[i] == "".join(c for c, g in zip(t, gone) if not g)


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, k):
    """Every stage on null and empty texts, repeated rows, a very long text, columns of clashing names, and on no rows."""
    first = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "same text here of six words", "en", "s", 27), (2, "same text here of six words", "en", "s", 27), (3, "w " * 200_000, None, None, 400_000), (4, None, None, "s", None)]
    more = spark.createDataFrame(rows, first.schema).selectExpr("*", "1 as n_words", "'x' as keep", "2 as hash", "'y' as fp", "3 as grp", "4 as wide", "'z' as _range", "5 as ids2")
    name, stage = P.STAGES[k]
    out = stage(spark, more, SF)
    got = out.collect()
    assert len(got) <= 6
    if name == "bpe":
        assert len(got) == 6
    else:
        assert out.columns == more.columns and {r.ids2 for r in got} <= {5}
    if name == "near_dedup":
        assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3"]
    if name == "substring_dedup":
        assert len(got) == 6 and min(len(r.text or "") for r in got if r.doc_id == 3) < 100
    assert stage(spark, more.limit(0), SF).count() == 0


def test_run_on_nothing(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0

"""Main text of HTML pages by equivalence-class template deduction.

Tokens of a page are its containers, told apart by their path of names, classes and ids (digits left out), and its text
blocks, told apart by the container and how often they stand there. A token's occurrence vector over the pages of one host
is held as two sums of 30-bit hashes of (page, count), which partial aggregation adds up for any number of pages: equal
vectors have equal sums, and copies of a page add to them alike. Tokens of equal vectors are one equivalence class.

1. Classes that are frequent (on three different pages and on SUPPORT of the host's pages at least, so a host has only a
   bounded number of tokens in them) and hold a container are candidates. A text on NEARLY_ALL of its container's
   pages joins the container's class, so that a few odd pages don't keep it.
2. Candidates are held against every page. Containers nest as their paths do, so a class's order can fail only among the
   tokens next to each other below one container: these must stand in the same order, once or over and over, on
   all pages, and must not cross those of a more frequent class. Tokens that fail leave the template. Classes whose text is
   more than SHARE of their pages' text are copies of content and lose their texts.
3. What is left nests into the host's template, by paths. Its gaps are slots. A container that holds DOMINANT of the
   text in its parent's slots, over all pages that have it, leads to the main slot: from the top, each page goes down along
   such containers, so each layout has its own way. An article or main element, or one with a first heading in a slot of its
   own, ends the way. Slots that are mostly links are left out.
4. The text of a page is what stands in its main slot, without template text.

Elements (nav, footer, aside, form ...), roles and names of class or id that mean menus, adverts, notices, forms or
comments say what a container is for: their text is in no slot. Pages of hosts with fewer than three different
pages, and what lies below the template on a page, are judged by the page's own shares of text in the same way.
Text blocks end at block-level tags; character references are decoded, white space becomes one space, blocks are joined by
a newline. Null and empty pages have the empty text. Pages without a host in their url make up one host. Repeated rows and
ids are judged alike. Extra columns pass through; one that has the name of the added column is replaced.
Time and memory are linear in a page's length: after the last ">" all is text, and once a quote in a tag doesn't end, quotes mean nothing in that page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.llm._util import checkpointed, column, ddl, matched, quoted, room, table

#: Different pages, and share of a host's pages, that a class stands on at least.
DISTINCT, SUPPORT = 3, 0.05
#: Share of a container's pages (and pages at least) that a text stands on to join its class.
NEARLY_ALL, PAGES = 0.8, 5
#: Share of the text of its pages that a class may have in texts.
SHARE = 0.3
#: Share of the text around it that a container must hold to be gone into; an article or main element; links in a slot that is left out.
DOMINANT, ARTICLE, LINKS = 0.85, 0.5, 0.7
#: Bytes of templates that are broadcast at most; beyond, they are copied for the parts that a host's pages are dealt to.
BROADCAST = 32 << 20
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_MARK = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([a-zA-Z_:][^\s=/>"']*+)\s*+(?:=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>]++))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noframes", "noembed"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINERS = {"html", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "menu", "dialog", "head", "svg", "math", "object", "select", "button", "fieldset", "details", "center", "figure", "blockquote", "canvas", "video", "audio", "map"}
_BLOCKS = _CONTAINERS - {"button", "svg", "math", "canvas"} | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "caption", "thead", "tbody", "tfoot", "pre", "hr", "address", "figcaption", "summary", "legend", "option", "optgroup", "hgroup", "search"}
_INLINE_SPACE = {"br", "td", "th"}
_OUT = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "svg", "math", "object", "select", "button", "canvas", "video", "audio", "map", "fieldset"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "note", "status"}
_OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs"
    " masthead header footer comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay"
    " newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations pagination pager tagcloud copyright disclaimer toolbar search form paywall announcement widget widgets skip".split()
)
_NOT_AFTER = {"with", "has", "have", "no", "without", "is", "not"}


@lru_cache(20_000)
def _element(name: str, attrs: str) -> tuple[str, bool, bool]:
    """(label, out of the main text by what it is, out by its class or id) of an element."""
    got: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs):
        got.setdefault(k.lower(), v[1:-1] if v[:1] in "\"'" else v)
    label = name
    if got.get("class"):
        label += "." + ".".join(sorted(re.sub(r"\d+", "", got["class"]).split()))
    if got.get("id"):
        label += "#" + re.sub(r"\d+", "", got["id"])
    words = [w.lower() for k in ("class", "id") for w in [*_WORDS.findall(got.get(k, "")), ""]]
    by_name = name in _OUT or got.get("role", "").lower() in _OUT_ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*+:\s*+none", got.get("style", "").lower()))
    by_word = name not in ("html", "body", "main") and any(w in _OUT_WORDS and (k == 0 or words[k - 1] not in _NOT_AFTER) for k, w in enumerate(words))
    return label, by_name, by_word


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


@lru_cache(50_000)
def _below(parent: int, label: str) -> int:
    """A container's key: the hash of its path."""
    return _hash(f"{parent}/{label}")


@lru_cache(100)
def _after(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I)


class Page:
    """Containers in order (node 0 is the page): parent (a node before), key of the path, name; blocks: (node, text, excluded, is a first heading, characters in links)."""

    def __init__(self, source: str, strict: bool = True):
        self.parent, self.key, self.name = [0], [0], [""]
        self.blocks: list[tuple[int, str, bool, bool, int]] = []
        self.order: list[int] = []  # what stands on the page, in order: nodes, and blocks as ~number
        stack: list[tuple[str, int, bool]] = []  # name, node around it, excluded around it
        opened: Counter = Counter()
        node, out, heading = 0, False, False
        parts: list[str] = []
        linked, in_link = 0, False
        pos, n, last, quotes = 0, len(source), source.rfind(">"), True

        def end() -> None:
            nonlocal heading, linked
            if parts:
                text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
                parts.clear()
                if text:
                    self.order.append(~len(self.blocks))
                    self.blocks.append((node, text, out, heading, min(linked, len(text))))
            heading, linked = False, 0

        while pos < n:
            at = source.find("<", pos)
            if at < 0 or at > last:
                parts.append(source[pos:])
                break
            if at > pos:
                parts.append(source[pos:at])
                linked += (at - pos) * in_link
            if source.startswith("<!--", at):
                pos = source.find("-->", at + 4)
                pos = n if pos < 0 else pos + 3
                continue
            if m := _PLAIN.match(source, at) if quotes else None:
                pos, attrs = m.end(), m[3]
            elif m := _NAME.match(source, at):
                pos = m.end()
                while quotes:
                    mark = _MARK.search(source, pos)
                    if mark is not None and mark[0] == ">":
                        break
                    close = source.find(mark[0], mark.end()) if mark else -1
                    if close < 0:
                        quotes = False
                    pos = close + 1
                gt = mark.start() if quotes else source.find(">", m.end())
                attrs, pos = source[m.end() : gt], gt + 1
            elif source[at + 1 : at + 2] in ("!", "?", "/"):
                pos = source.find(">", at) + 1
                continue
            else:
                parts.append("<")
                pos = at + 1
                continue
            name, closing = m[2].lower(), m[1] == "/"
            if name in _RAW:
                if not closing:
                    after = _after(name).search(source, pos) if pos <= last else None
                    pos = after.end() if after else n
                continue
            if name == "a":
                in_link = not closing
            if name in _INLINE_SPACE:
                parts.append(" ")
                continue
            if name in _BLOCKS:
                end()
            if name == "h1":
                heading = not closing
            if name not in _CONTAINERS:
                continue
            if not closing:
                label, by_name, by_word = _element(name, attrs) if len(attrs) < 1000 else _element.__wrapped__(name, attrs)
                stack.append((name, node, out))
                out = out or by_name or (name == "header" and not opened["article"] and not opened["main"]) or (strict and by_word)
                opened[name] += 1
                self.parent.append(node)
                self.key.append(_below(self.key[node], label) if len(label) < 200 else _below.__wrapped__(self.key[node], label))
                self.name.append(name)
                node = len(self.key) - 1
                self.order.append(node)
            elif opened[name]:
                while True:
                    was, node, out = stack.pop()
                    opened[was] -= 1
                    if was == name:
                        break
        end()
        if strict and source and not any(not b[2] for b in self.blocks):
            loose = Page(source, strict=False)
            if any(not b[2] for b in loose.blocks):
                self.__dict__ = loose.__dict__

    def texts(self) -> list[int]:
        """The token of each block, 0 for excluded ones."""
        seen = Counter((self.key[b[0]], b[1]) for b in self.blocks if not b[2])
        return [0 if b[2] else _hash(f"{self.key[b[0]]}={seen[self.key[b[0]], b[1]]}={b[1]}") for b in self.blocks]

    def around(self, elements) -> list[int]:
        """The nearest node, itself included, that is of elements (keys), else 0, of every node."""
        out = [0]
        for k in range(1, len(self.key)):
            out.append(k if self.key[k] in elements else out[self.parent[k]])
        return out


_TOKEN = pa.schema([("host", pa.string()), ("token", pa.int64()), ("kind", pa.int64()), ("parent", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64()), ("pages", pa.int64()), ("bits", pa.int64())])
_CANDIDATE = pa.schema([("host", pa.string()), ("tokens", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64()))])
_CHECK = pa.schema([("host", pa.string()), ("what", pa.int64()), ("a", pa.int64()), *((f"n{k}", pa.int64()) for k in range(5)), ("lo", pa.int64()), ("hi", pa.int64())])
_TEMPLATE = pa.schema([("host", pa.string()), *((c, pa.list_(pa.int64())) for c in ("elements", "dominant", "articles", "links", "fixed"))])
#: Kinds of tokens: container, text, text that joined its container's class, all pages with text.
ELEMENT, TEXT, JOINED, WHOLE = 0, 1, 2, 3
#: What a row of checks is about: a container's text, a class's text, a token's order.
HELD, CLASS, ORDER = 0, 1, 2


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint' if f.type == pa.int64() else 'array<bigint>'}" for f in schema)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(schema))], schema=schema)


def _tokens(hosts: list[str], sources: list[str]) -> list[tuple]:
    """Rows of _TOKEN over some pages."""
    of: dict[tuple[str, int], list[int]] = {}
    for host, source in zip(hosts, sources, strict=True):
        page = Page(source)
        texts = page.texts()
        if not any(texts):
            continue
        digest = xxhash.xxh3_64_intdigest(source.encode("utf-8", "replace"))
        bit = (1 << (digest & 63)) - ((digest & 63) == 63) * 2**64
        parents = {k: page.key[p] for k, p in zip(page.key[1:], page.parent[1:], strict=True)}
        seen = Counter(page.key[1:])
        rows = [(0, WHOLE, 0, 1), *((k, ELEMENT, parents[k], c) for k, c in seen.items())]
        rows += {t: (t, TEXT, page.key[b[0]], 1) for t, b in zip(texts, page.blocks, strict=True) if t}.values()
        for token, kind, parent, c in rows:
            h = xxhash.xxh3_64_intdigest(f"{digest}:{c}".encode())
            x = of.setdefault((host, token), [kind, parent, 0, 0, 0, 0])
            x[2] += h & 0x3FFFFFFF
            x[3] += h >> 34
            x[4] += 1
            x[5] |= bit
    return [(*k, *x) for k, x in of.items()]


def _candidates(t: pa.Table) -> pa.Table:
    """The candidate tokens of one host with their classes, numbered from the most frequent."""
    rows = t.to_pylist()
    classes: dict[tuple, list[dict]] = {}
    for r in rows:
        classes.setdefault((-r["pages"], r["v1"], r["v2"]), []).append(r)
    kept = [c for _, c in sorted(classes.items()) if any(r["kind"] == ELEMENT for r in c)]
    out = {r["token"]: (r["kind"], k) for k, c in enumerate(kept) for r in c}
    pages = {r["token"]: r["pages"] for r in rows if r["token"] in out and r["kind"] == ELEMENT}
    for r in rows:
        if r["kind"] == TEXT and r["token"] not in out and r["parent"] in pages and r["pages"] >= max(PAGES, NEARLY_ALL * pages[r["parent"]]):
            out[r["token"]] = (JOINED, out[r["parent"]][1])
    if not out:
        return pa.table([[]] * len(_CANDIDATE), schema=_CANDIDATE)
    return pa.table([[rows[0]["host"]], [list(out)], [[k for k, _ in out.values()]], [[c for _, c in out.values()]]], schema=_CANDIDATE)


def _sums(page: Page, around: list[int], values: list[int]) -> list[int]:
    """For every node what the blocks' values add up to in and below it, as far as nodes are their own `around`."""
    total = [0] * len(page.key)
    for b, v in zip(page.blocks, values, strict=True):
        total[around[b[0]]] += v
    for k in range(len(total) - 1, 0, -1):
        if around[k] == k:
            total[around[page.parent[k]]] += total[k]
    return total


def _failed(sequence: list[tuple[int, int]]) -> tuple[dict[int, int], set[int]]:
    """sequence: (class, token) below one container, in order. A hash of the order of each class (0 if it isn't a whole number of repetitions), and the classes that cross more frequent ones."""
    by: dict[int, list[int]] = {}
    for c, t in sequence:
        by.setdefault(c, []).append(t)
    order, length = {}, {}
    for c, seq in by.items():
        pattern = list(dict.fromkeys(seq))
        length[c] = len(pattern)
        order[c] = (_hash(",".join(map(str, pattern))) | 1) if seq == pattern * (len(seq) // len(pattern)) else 0
    crossed: set[int] = set()
    place: Counter = Counter()
    stack: list[int] = []  # classes with a repetition begun and not ended
    for c, _ in sequence:
        if not order[c]:
            continue
        if place[c] % length[c] == 0:
            stack.append(c)
        elif c not in crossed:
            while stack[-1] != c:  # it began inside and goes on beyond
                crossed.add(max(stack[-1], c))
                if stack[-1] not in crossed:
                    break
                stack.pop()
        place[c] += 1
        while stack and (stack[-1] in crossed or place[stack[-1]] % length[stack[-1]] == 0):
            stack.pop()
    return order, crossed


def _checks(hosts: list[str], sources: list[str], candidates: list[dict[int, tuple[int, int]] | None]) -> list[tuple]:
    """Rows of _CHECK over some pages; candidates: each page's tokens with kind and class."""
    of: dict[tuple, list[int]] = {}
    for host, source, known in zip(hosts, sources, candidates, strict=True):
        if not known:
            continue
        page = Page(source)
        texts = page.texts()
        if not any(texts):
            continue
        around = page.around(known)
        sizes = [len(b[1]) * (t != 0) for b, t in zip(page.blocks, texts, strict=True)]
        free = [n * (t not in known) for n, t in zip(sizes, texts, strict=True)]
        every, var = _sums(page, around, sizes), _sums(page, around, free)
        links = _sums(page, around, [b[4] * (t != 0) for b, t in zip(page.blocks, texts, strict=True)])
        held: dict[int, list] = {}
        for k in range(1, len(page.key)):
            if around[k] == k:
                p = around[page.parent[k]]
                x = held.setdefault(page.key[k], [0, 0, 0, 0, 0, set()])
                x[0] += var[k]
                x[2] += every[k]
                x[4] += links[k]
                if p not in x[5]:
                    x[5].add(p)
                    x[1] += var[p]
                    x[3] += every[p]
        for key, x in held.items():
            y = of.setdefault((host, HELD, key), [0, 0, 0, 0, 0, 0, 0])
            for j in range(5):
                y[j] += x[j]
        marks: dict[int, list[tuple[int, int]]] = {}  # class and token of what stands in a container, in order
        for k in page.order:
            t, p = (page.key[k], page.parent[k]) if k >= 0 else (texts[~k], page.blocks[~k][0])
            if t in known and known[t][0] != JOINED:
                marks.setdefault(around[p], []).append((known[t][1], t))
        of_class: dict[int, int] = {}
        for t, b in zip(texts, page.blocks, strict=True):
            if t in known:
                of_class[known[t][1]] = of_class.get(known[t][1], 0) + len(b[1])
        for c, n in of_class.items():
            y = of.setdefault((host, CLASS, c), [0, 0, 0, 0, 0, 0, 0])
            y[0] += n
            y[1] += every[0]
        for sequence in marks.values():
            order, crossed = _failed(sequence)
            for c, t in dict.fromkeys(sequence):
                h = order[c] if c not in crossed else 0
                y = of.setdefault((host, ORDER, t), [0, 0, 0, 0, 0, h, h])
                y[5], y[6] = min(y[5], h), max(y[6], h)
    return [(*k, *x) for k, x in of.items()]


def _template(host: str, candidates: dict, checks: list[dict]) -> tuple:
    """A row of _TEMPLATE: the valid containers, those that lead to the main slot, article and main ones among these, those of links, and the template texts."""
    of = {(r["what"], r["a"]): r for r in checks}
    kind = dict(zip(candidates["tokens"], candidates["kinds"], strict=True))
    cls = dict(zip(candidates["tokens"], candidates["classes"], strict=True))

    def valid(t: int) -> bool:
        r = of.get((ORDER, t))
        return kind[t] == JOINED or (r is not None and r["lo"] == r["hi"] != 0)

    copies = {a for (what, a), r in of.items() if what == CLASS and r["n0"] > SHARE * r["n1"]}
    elements = [t for t in kind if kind[t] == ELEMENT and valid(t)]
    fixed = [t for t in kind if kind[t] != ELEMENT and valid(t) and cls[t] not in copies]
    share = {}
    for t in elements:
        # without template text, unless there is little else
        r = of[HELD, t]
        n, around = (r["n0"], r["n1"]) if r["n1"] >= (1 - SHARE) * r["n3"] else (r["n2"], r["n3"])
        share[t] = n / around if around else 0.0
    links = [t for t in elements if of[HELD, t]["n2"] and of[HELD, t]["n4"] >= LINKS * of[HELD, t]["n2"] and share[t] < SHARE]
    return host, elements, [t for t in elements if share[t] >= DOMINANT], [t for t in elements if share[t] >= ARTICLE], links, fixed


def _with_host(pages: DataFrame, of_host: DataFrame, columns: list[str], source: str) -> DataFrame:
    """pages (with host) with the columns of of_host (one row for each host) for their host; a host's pages are dealt by their source where of_host is large."""
    size = of_host.agg(F.sum(F.octet_length("host") + sum((8 * F.size(c) for c in columns), F.lit(64)))).first()[0] or 0
    return matched(pages, of_host.select("host", *columns), "host", source, size <= BROADCAST)


def host_column(url):
    """The part of a url after the first :// up to / ? # or the end, in lower case; empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.lower(F.regexp_extract(F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit("")), r"^[^/?#]*", 0)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host and its template: elements (keys of valid containers), dominant, articles, links (some of these; see `_template`) and fixed (template texts)."""
    both = pages.select(host_column(column(pages, url)).alias("host"), F.coalesce(column(pages, source), F.lit("")).alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(_TOKEN, _tokens(b.column(0).to_pylist(), b.column(1).to_pylist()))

    some = both.mapInArrow(count, _sql(_TOKEN)).groupBy("host", "token").agg(F.min("kind").alias("kind"), F.min("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("v1", "v2", "pages")], F.bit_or("bits").alias("bits"))
    some = checkpointed(some.where((F.col("kind") == WHOLE) | (F.bit_count("bits") >= DISTINCT)).drop("bits"))
    whole = some.where(F.col("kind") == WHOLE).select("host", F.col("pages").alias("n"))
    # At most (tokens of a page) / SUPPORT for each host.
    frequent = some.where(F.col("kind") != WHOLE).join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("n")).drop("n")
    candidates = checkpointed(frequent.groupBy("host").applyInArrow(_candidates, _sql(_CANDIDATE)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, h = b.column(0).to_pylist(), b.column(1).to_pylist()
            known: dict[str, dict] = {}
            for k, name in enumerate(host):
                if name not in known and b.column(2)[k].is_valid:
                    tokens, kinds, classes = (b.column(c)[k].as_py() for c in (2, 3, 4))
                    known[name] = dict(zip(tokens, zip(kinds, classes, strict=True), strict=True))
            yield _batch(_CHECK, _checks(host, h, [known.get(name) for name in host]))

    held = _with_host(both, candidates, ["tokens", "kinds", "classes"], "h").select("host", "h", "tokens", "kinds", "classes").mapInArrow(check, _sql(_CHECK))
    held = held.groupBy("host", "what", "a").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(5)], F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([[]] * len(_TEMPLATE), schema=_TEMPLATE)
        [row] = left.to_pylist()
        return pa.Table.from_batches([_batch(_TEMPLATE, [_template(row["host"], row, right.to_pylist())])])

    return candidates.groupBy("host").cogroup(held.groupBy("host")).applyInArrow(made, _sql(_TEMPLATE))


def _way(page: Page, sizes: list[int], elements, dominant, articles, start: list[int]) -> tuple[list[int], bool]:
    """The containers at the end of the way down from start, and whether more of elements hold text below them. Null dominant: the page's own shares."""
    around = page.around(elements)
    total = _sums(page, around, sizes)
    kids: dict[int, list[int]] = {}
    for k in range(1, len(total)):
        if around[k] == k and total[k]:
            kids.setdefault(around[page.parent[k]], []).append(k)
    headed = {around[b[0]] for b, n in zip(page.blocks, sizes, strict=True) if n and b[3]}
    at = start
    while True:
        by: dict[int, list[int]] = {}
        for a in at:
            for k in kids.get(a, ()):
                by.setdefault(page.key[k], []).append(k)
        if not by or page.name[at[0]] in ("article", "main") or any(a in headed for a in at):
            return at, bool(by)
        n = {key: sum(total[k] for k in ks) for key, ks in by.items()}
        whole = sum(total[a] for a in at)
        into = [key for key in by if (key in dominant if dominant is not None else n[key] >= DOMINANT * whole)]
        end = not into
        if end:
            into = [key for key, ks in by.items() if page.name[ks[0]] in ("article", "main") and (key in articles if dominant is not None else n[key] >= ARTICLE * whole)]
        if not into:
            return at, True
        at = by[max(into, key=n.__getitem__)]
        if end:
            return at, True


def extract_one(source: str | None, template: dict | None = None) -> str:
    page = Page(source or "")
    if template is None:
        template = {c: frozenset() for c in _TEMPLATE.names[1:]}
    if template["fixed"]:
        texts = page.texts()
        sizes = [len(b[1]) * (t != 0 and t not in template["fixed"]) for b, t in zip(page.blocks, texts, strict=True)]
    else:
        sizes = [len(b[1]) * (not b[2]) for b in page.blocks]
    if not any(sizes):
        return ""
    at, more = _way(page, sizes, template["elements"], template["dominant"], template["articles"], [0])
    links = template["links"]
    if not more and page.name[at[0]] not in ("article", "main"):
        at, _ = _way(page, sizes, set(page.key), None, None, at)
        links = ()
    inside = [False] * len(page.key)
    for a in at:
        inside[a] = True
    for k in range(1, len(inside)):
        inside[k] = inside[k] or (inside[page.parent[k]] and page.key[k] not in links)
    return "\n".join(b[1] for b, n in zip(page.blocks, sizes, strict=True) if n and inside[b[0]])


def extract(pages: DataFrame, url: str = "url", source: str = "html", out: str = "text") -> DataFrame:
    """pages without their html, with the main text."""
    pages = pages if out == source else room(pages, [out], (url, source))
    parts = _TEMPLATE.names[1:]
    found = checkpointed(templates(pages, url, source))
    # The page's own columns go along in one, so that none of their names can clash.
    rows = pages.select(F.struct(*[column(pages, c) for c in pages.columns]).alias("p"), F.coalesce(column(pages, source), F.lit("")).alias("h"), host_column(column(pages, url)).alias("host"))
    rows = _with_host(rows, found, parts, "h")
    names = pages.columns
    kept = [c for c in names if c != source]
    rows = rows.select(*[F.col("p").getField(c).alias(f"c{k}") for k, c in enumerate(kept)], "h", "host", *parts)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source_, host = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            known: dict[str, dict] = {}
            for k, name in enumerate(host):
                if name not in known and b.column(n + 2)[k].is_valid:
                    known[name] = {c: frozenset(b.column(n + 2 + j)[k].as_py()) for j, c in enumerate(parts)}
            made = [extract_one(s, known.get(name)) for s, name in zip(source_, host, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), pa.array(made, pa.string())], names=[*kept, out])

    return rows.mapInArrow(run, ", ".join([*([ddl([pages.schema[c] for c in kept])] if kept else []), f"{quoted(out)} string"]))


def op2_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

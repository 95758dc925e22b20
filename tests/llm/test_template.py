"""Template deduction: hosts of several layouts, and explicit occurrence vectors beside the operator's sums."""

import random
from collections import Counter, defaultdict

from descmap.llm import template as T

WORDS = "river stone cloud lamp green seven walks table quick under over mixed tail".split()


def story(r, k):
    return " ".join(r.choice(WORDS) + str(r.randrange(900)) for _ in range(k))


def host_of_layouts(seed: int, name: str) -> list[tuple[str, str, str]]:
    """(url, html, main text) of pages in three layouts without telling names, with copies, an empty and an odd page."""
    r = random.Random(seed)
    out = []
    for k in range(36):
        title, paras = story(r, 4), [story(r, 40) for _ in range(r.randrange(1, 5))]
        body = "".join(f"<p>{p}</p>" for p in paras)
        teaser = f"<div class=k9><p>{story(r, 6)}</p></div>"
        if k % 3 == 0:  # a fixed line in the slot, and variable text beside it
            html = f"<html><body><div class=x1><div class=top><p>The {name} paper</p></div><div class=c><h1>{title}</h1>{body}<p>Send us a line</p></div>{teaser}</div></body></html>"
        elif k % 3 == 1:  # the same container as below, whose line goes with an element elsewhere
            html = f"<html><body><div class=shared>{body}<p>Checked by the desk</p></div><div class=only-here><p>{story(r, 5)}</p></div></body></html>"
            title = None
        else:
            html = f"<html><body><div class=shared>{body}</div></body></html>"
            title = None
        out.append((f"http://{name}/{k}", html, "\n".join([title, *paras] if title else paras)))
    out += [out[4]] * 7 + [out[3]] * 2
    out += [(f"http://{name}/e", "", ""), (f"http://{name}/o", "<html><body><table><tr><td>No such page</td></tr></table></body></html>", "No such page")]
    r.shuffle(out)
    return out


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(k, u, h) for k, (u, h, *_) in enumerate(rows)], "page_id bigint, url string, html string").repartition(parts, "page_id")


def test_layouts(spark, monkeypatch):
    """Text that stands on a part of a host's pages goes with that part's containers; no name tells it."""
    rows = [x for k in range(2) for x in host_of_layouts(k, f"h{k}.org")]
    got = {r.page_id: r.text for r in T.extract(pages_of(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == [x[2] for x in rows]
    monkeypatch.setattr(T, "BROADCAST", 0)  # templates too large to broadcast
    got = {r.page_id: r.text for r in T.extract(pages_of(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == [x[2] for x in rows]
    # the template is what does it
    assert sum(T.extract_one(h) != want for _, h, want in rows) > len(rows) / 2


def brute_template(sources: list[str]) -> tuple[set, set]:
    """Valid containers and template texts from whole vectors: lists of counts over the pages."""
    pages = [p for p in map(T.Page, sources) if any(p.texts())]
    distinct = [s for s in sources if any(T.Page(s).texts())]
    counts, where, element = [], {}, set()
    for p in pages:
        c = Counter(p.key[1:])
        element |= set(c)
        for t, b in zip(p.texts(), p.blocks):
            if t:
                c[t], where[t] = 1, p.key[b[0]]
        counts.append(c)
    vector = {t: tuple(c[t] for c in counts) for t in set().union(*counts)}
    on = {t: [k for k, n in enumerate(v) if n] for t, v in vector.items()}
    frequent = {t for t in vector if len({distinct[k] for k in on[t]}) >= T.DISTINCT and len(on[t]) >= T.SUPPORT * len(pages)}
    classes = defaultdict(set)
    for t in frequent:
        classes[vector[t]].add(t)
    classes = {v: c for v, c in classes.items() if c & element}
    of = {t: v for v, c in classes.items() for t in c}
    bad = set()
    for v, c in classes.items():
        seen = defaultdict(set)
        for p in pages:
            below = defaultdict(list)
            around = p.around(of)
            texts = p.texts()
            for k in p.order:
                t, at = (p.key[k], around[p.parent[k]]) if k >= 0 else (texts[~k], around[p.blocks[~k][0]])
                if t in c:
                    below[at].append(t)
            for at, seq in below.items():
                pattern = tuple(dict.fromkeys(seq))
                whole = list(pattern) * (len(seq) // len(pattern)) == seq
                for t in set(seq):
                    seen[t].add(pattern if whole else None)
        bad |= {t for t in c if len(seen[t]) > 1 or None in seen[t]}
    joined = {t for t in where if t in frequent and t not in of and where[t] in of and len(on[t]) >= max(T.PAGES, T.NEARLY_ALL * len(on[where[t]]))}
    cls = of | {t: of[where[t]] for t in joined}
    copies = set()
    for v in set(cls.values()):
        own = total = 0
        for p in pages:
            mine = sum(len(b[1]) for t, b in zip(p.texts(), p.blocks) if t and cls.get(t) == v)
            own += mine
            total += sum(len(b[1]) for b in p.blocks if not b[2]) * (mine > 0)
        if own > T.SHARE * total:
            copies.add(v)
    return {t for t in of if t in element} - bad, {t for t, v in cls.items() if t not in element and v not in copies} - bad


def test_against_vectors(spark):
    rows = [x for k in range(3) for x in host_of_layouts(10 + k, f"h{k}.org")]
    r = random.Random(4)
    # a host whose containers change places and repeat
    for k in range(20):
        some = [f"<div class=one><p>{story(r, 9)}</p><p>first fixed</p></div>", f"<div class=two><p>{story(r, 9)}</p><p>second fixed</p></div>"]
        if k % 2:
            some.reverse()
        cells = "".join(f"<section class=cell><div class=a>{story(r, 3)}</div><div class=b>{story(r, 3)}</div></section>" for _ in range(r.randrange(1, 4)))
        rows.append((f"http://swap.org/{k}", f"<html><body>{''.join(some)}<div class=rest>{story(r, 60)}{cells}</div></body></html>", None))
    got = {t.host: (set(t.elements), set(t.fixed)) for t in T.templates(pages_of(spark, rows, 5)).collect()}
    by = defaultdict(list)
    for u, h, _ in rows:
        by[u.split("/")[2]].append(h)
    assert set(got) == set(by)
    for name, sources in by.items():
        assert got[name] == brute_template(sources), name
    assert all(fixed for _, fixed in (got[n] for n in by if n != "swap.org"))


def test_copies_of_content_stay(spark):
    """Near copies share most of their blocks; none of these is template text."""
    r = random.Random(8)
    same = [story(r, 30) for _ in range(6)]
    rows = [(f"http://c.org/{k}", "<html><body><article>" + "".join(f"<p>{p}</p>" for p in [*same, f"edit {k}"]) + "</article></body></html>", "\n".join([*same, f"edit {k}"])) for k in range(40)]
    got = {x.page_id: x.text for x in T.extract(pages_of(spark, rows)).collect()}
    assert [got[k] for k in range(40)] == [x[2] for x in rows]


def test_crossing_and_order():
    a, b, c = 11, 12, 13
    assert T._failed([(0, a), (1, c), (0, b)]) == ({0: T._failed([(0, a), (0, b)])[0][0], 1: T._failed([(1, c)])[0][1]}, set())
    assert T._failed([(0, a), (1, c), (0, b), (1, 14)])[1] == {1}
    assert T._failed([(0, a), (0, b), (0, b)])[0][0] == 0
    assert T._failed([(0, a), (0, b)] * 3)[0][0] == T._failed([(0, a), (0, b)])[0][0] != 0
    assert T._failed([(0, a), (1, c), (0, a), (1, c), (0, a)])[1] == set()


def test_long_and_broken_pages():
    """Linear in the page's length: each of these took seconds to minutes when it was not."""
    import time

    for s in ("<a " * 40000, "<div>" * 30000 + "x" + "</section>" * 30000, '<a "' * 40001 + '>">', "<script" * 40000 + ">", "<p class='" * 40000, "<script>x</script " * 20000 + "<", "<div class='" + "a" * 200000, "<p a=\"" * 40000 + ">"):
        start = time.time()
        T.extract_one(s)
        assert time.time() - start < 5


def test_clashing_names(spark):
    names = ["_h", "_fixed", "_elements", "host", "p", "h", "c0", "token"]
    rows = spark.createDataFrame([(1, "http://a.org", "<p>x</p>", *names), (None, None, None, *names)], "page_id bigint, url string, html string, " + ", ".join(f"`{n}` string" for n in names) + "")
    out = T.extract(rows)
    assert out.columns == ["page_id", "url", *names, "text"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "http://a.org", *names, "x"), (None, None, *names, "")], key=str)
    assert T.extract(rows, out="html").columns == ["page_id", "url", *names, "html"]

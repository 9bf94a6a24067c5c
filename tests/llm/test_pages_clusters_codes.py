"""Operators 11 to 13 against plain loops."""

import hashlib
import html
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest

from crumbline.llm import codes, elkan, exact, pagediff, registry

from ..twins import DATA, assert_twin


# ---- 11: pages ----------------------------------------------------------------------------------------------------------------


def said(page):
    return [(t, k) for t, k in pagediff.lines(page)]


def main_text(page):
    return " ".join(t for t, k in pagediff.lines(page) if k == pagediff.MAIN)


def test_every_article_of_the_table_is_whole(spark):
    pages = duckdb.sql(f"select page_id, html from '{DATA}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in pagediff.query(spark, DATA).collect()}
    assert len(got) == len(pages)
    for page_id, page in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", inner))).split())
        assert (got[page_id].text, got[page_id].n_chars) == (want, len(want))


def test_markup_tells_the_article_from_the_rest():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="<article>no</article>";</script></head><body class="has-sidebar">
      <form id=all><nav><ul><li><a href=/>Menu</a></nav><header>Site</header><div id="cookie-notice">We use cookies</div>
      <article class=post><header><h1>A &amp; B</h1><p>by someone</p></header><p>One&nbsp;two<b>three</b>
      four<br>five<aside>Side</aside><div class="ad-slot">Buy</div><p hidden>secret</p><form><p>Mail?</p></form><ul><li>six<li>seven</ul>
      <footer>posted</footer></article><section id=comments><article>first!</article></section></form><footer>End</footer></body></html>"""
    assert main_text(page) == "A & B One twothree four five six seven"
    assert all(k != pagediff.OPEN for _, k in said(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("no markup at all", ""),
        ("<article><p>cut off in a <b>ta", "cut off in a ta"),
        ("<article>cut off in a tag <a href='x", "cut off in a tag"),
        ("<article>a<!-- never closed <p>b", "a"),
        ("<article>a<script>x('</p>')", "a"),
        ("<nav><ul><li>menu<article>inside an open menu", "inside an open menu"),
        ("</div></article><article>x</p></div>y", "x y"),
        ("<main><p class='ad'>buy<p>read</main>", "read"),
        ("<article>a &lt;b&gt; &#233; &unknown; &amp;amp;</article>", "a <b> é &unknown; &amp;"),
        ("<ARTICLE>A<P title='a>b'>C</ARTICLE>D", "A C"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
        ("<div role=main><div aria-hidden=true>x</div>y</div>", "y"),
    ],
)
def test_broken_and_odd_markup(page, want):
    assert main_text(page) == want


def test_lines_of_links_outside_an_article_are_menus():
    assert said("<div><a href=/>Home</a> <a href=/b>About us</a></div><p>Text with a <a href=/c>link</a> in it</p>") == [
        ("Home About us", pagediff.OUT), ("Text with a link in it", pagediff.OPEN)]


def test_long_and_deeply_broken_pages_take_linear_time():
    began = time.time()
    assert len(main_text("<article>" + "<div><p>word &amp; " * 100_000).split()) == 200_000
    pagediff.lines("<div>" * 100_000 + "</nav></section>" * 100_000)
    pagediff.lines("<a title=\"it's " * 50_000)
    assert time.time() - began < 30


def plain_lcs(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_alignment_is_a_longest_common_subsequence():
    for seed in range(400):
        r = random.Random(seed)
        a, b = ([r.randrange(1, r.choice([3, 6, 20])) for _ in range(r.randrange(25))] for _ in range(2))
        found, rest = pagediff.aligned(a, b), iter(b)
        assert len(found) == plain_lcs(a, b)
        assert all(any(a[i] == y for y in rest) for i in found)


def plain_pages(rows):
    """Texts of pages by sorting each host in one list and aligning neighbours; words of a page are unique, so the alignment is, too."""
    by_host = {}
    for _, url, page in rows:
        host, path = pagediff.place(url)
        key = (tuple(pagediff.lines(page or "")))
        hosts = by_host.setdefault(host, {})
        hosts[key] = min(hosts.get(key, path), path)
    out = []
    for page_id, url, page in rows:
        host, _ = pagediff.place(url)
        own = tuple(pagediff.lines(page or ""))
        ids = {k: pagediff.signature(pagediff.hashed(list(k)), bytes(x for _, x in k)) for k in by_host[host]}
        order = sorted(by_host[host], key=lambda k: (by_host[host][k], ids[k]))
        i = order.index(own)

        def alike(j):
            n = 0
            for x, y in zip(by_host[host][own].split("/"), by_host[host][order[j]].split("/")):
                if x != y:
                    break
                n += 1
            return n

        near = [j for j in (i - 1, i + 1) if 0 <= j < len(order)]
        other = {t for t, _ in order[max(near, key=alike)]} if near else set()
        kept = [t for t, k in own if k == pagediff.MAIN or (k == pagediff.OPEN and t not in other)]
        if not kept:
            kept = [t for t, k in own if k != pagediff.OUT]
        out.append((page_id, url, " ".join(kept)))
    return out


def site(seed, n=160):
    """Pages without articles: a frame that changes along the paths, texts of their own, some copies."""
    r, rows = random.Random(seed), []
    for i in range(n):
        host, part = r.choice(["a.example", "a.example", "a.example", "b.example", f"c{i}.example"]), r.choice(["news", "news/x", "shop"])
        frame = [f"{host} {part} top", f"{host} menu", f"text {i} one", f"text {i} two", f"{part} foot"][r.randrange(2) :]
        page = "".join(f"<p>{t}</p>" for t in frame) + r.choice(["", "<nav>n</nav>"])
        rows.append((i, f"http://{host}/{part}/{r.randrange(60)}?q={i}", page))
        if r.random() < 0.1:
            rows.append((1000 + i, f"http://{host}/{part}/copy{i}", page))
    return rows


@pytest.mark.parametrize("few", [50_000, 0])
def test_undecided_lines_shared_with_the_nearest_page_go(spark, few):
    rows = site(3)
    got = pagediff.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), few=few, often=0.02).collect()
    assert sorted((r.page_id, r.url, r.text) for r in got) == sorted(plain_pages(rows))
    assert sum(r.n_deleted for r in got) > 100 and all(r.n_chars == len(r.text) for r in got)


def test_shared_lines_of_articles_stay_and_odd_rows_are_kept(spark):
    rows = [
        (1, "http://h.example/a", "<article><p>same</p></article><p>around</p>"),
        (2, "http://h.example/b", "<article><p>same</p><p>more</p></article><p>around</p>"),
        (3, None, None), (None, "http://[broken", "<p>x</p>"), (4, "no url", ""), (4, "no url", ""), (5, "http://h.example/c", "<div></div>"),
    ]
    got = pagediff.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS host", "4 AS `at`")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "x"), (1, "same"), (2, "same more"), (3, ""), (4, ""), (4, ""), (5, "")]
    assert pagediff.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- 12: clusters ---------------------------------------------------------------------------------------------------------------


def integers(v, scale):
    return [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_clusters(rows, k, rounds, scale, dims):
    kept = [(i, integers(v, scale)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))[:k]
    c = [v for _, v in first]
    if not c:
        return []
    for turn in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (d2(v, c[j]), j)) for _, v in kept]
        if turn < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), a in zip(kept, own) if a == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [d2(v, c[a]) for (_, v), a in zip(kept, own)]
    each = {a: sum(x for x, b in zip(d, own) if b == a) for a in own}
    fit = lambda n: n if n < 2**63 else None
    by = {a: fit(s) if all(fit(x) is not None for x, b in zip(d, own) if b == a) else None for a, s in each.items()}
    total = fit(sum(d)) if all(v is not None for v in map(fit, d)) else None
    return [(i, a, fit(x), by[a], total, hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, own, d)]


VECTORS = "vec_id long, embedding array<float>, label int"


def made_up(seed, n, dims, wide=1.0, step=8):
    """Few different values, so that many distances tie; repeated rows, odd rows."""
    r = random.Random(seed)
    rows = [(i, [wide * r.randrange(-step, step) / step for _ in range(dims)], r.choice([None, 1, 2])) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [None] * dims, 1), (n + 3, [float("nan")] * dims, 2), (n + 4, [float("inf")] + [0.0] * (dims - 1), 2)]
    return rows + odd + rows[: n // 4] + [(None, rows[0][1], 1)]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("n", "k", "dims", "wide"), [(300, 16, 4, 1.0), (60, 5, 2, 1e20), (200, 7, 1, 1.0), (3, 16, 4, 1.0), (40, 6, 3, 3e9), (1, 1, 2, 1.0), (0, 4, 2, 1.0)])
def test_clusters_equal_plain_loops(spark, n, k, dims, wide):
    rows = made_up(n + k, n, dims, wide) if n else []
    exact_rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS cluster", "2 AS upper", "3 AS distance").repartition(3)
    got = elkan.clustered(df, k=k, dims=dims).collect()
    same(got, plain_clusters(exact_rows, k, 3, 64, dims))


def test_bounds_skip_distances_and_keep_ties():
    r = np.random.default_rng(5)
    c = np.floor(r.normal(size=(16, 8)) * 1000)
    x = np.floor(c[r.integers(0, 16, 4000)] + r.normal(size=(4000, 8)) * 60)
    first = elkan.nearest(x, c, elkan.halves(c.astype(int).tolist()), np.zeros(4000, dtype=int), np.full(4000, np.inf), np.zeros((4000, 16)))
    d = exact.distances(x, c)
    assert (first[0] == d.argmin(axis=1)).all() and first[3] < 0.75 * d.size
    assert (first[1] >= np.sqrt(d[np.arange(4000), first[0]])).all() and (first[2] <= np.sqrt(d)).all()
    again = elkan.nearest(x, c, elkan.halves(c.astype(int).tolist()), first[0], first[1], first[2])
    assert (again[0] == first[0]).all() and again[3] < 100


@pytest.mark.parametrize("name", ["op12_centroid_elkan", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    assert_twin(spark, registry.QUERIES[name], registry.ORACLES[name])


# ---- 13: codes ------------------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, integers(v, scale), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for _, v, _ in kept] for p in range(parts)]
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        book = [list(x) for x in cut[p][:entries]]
        for turn in range(rounds + 1):
            own = [min(range(len(book)), key=lambda j: (d2(x, book[j]), j)) for x in cut[p]]
            if turn < rounds:
                for j in set(own):
                    mine = [x for x, a in zip(cut[p], own) if a == j]
                    book[j] = [sum(x) // len(mine) for x in zip(*mine)]
        for at, (x, a) in enumerate(zip(cut[p], own)):
            code[at] += f"{a:02x}"
            error[at] += d2(x, book[a])
        books += [n for row in book for n in row]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    fit = lambda n: n if n is not None and n < 2**63 else None
    by = {label: sum(e for e, r in zip(error, kept) if r[2] == label) for label in {r[2] for r in kept}}
    by = {label: None if any(fit(e) is None for e, r in zip(error, kept) if r[2] == label) else fit(s) for label, s in by.items()}
    return [(r[0], c, fit(e), by[r[2]], digest) for r, c, e in zip(kept, code, error)]


@pytest.mark.parametrize(
    ("n", "entries", "dims", "wide", "often", "labels"),
    [(300, 16, 8, 1.0, 0.001, 100), (300, 40, 4, 1.0, 2.0, 0), (60, 256, 4, 1.0, 0.05, 100), (50, 8, 4, 1e20, 0.05, 0), (80, 9, 8, 1e7, 0.05, 100), (1, 256, 4, 1.0, 0.001, 100), (0, 4, 4, 1.0, 0.001, 100)],
)
def test_codes_equal_plain_loops(spark, n, entries, dims, wide, often, labels):
    rows = made_up(n + entries, n, dims, wide, step=2) if n else []
    exact_rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS pos", "2 AS part", "3 AS row", "4 AS code", "5 AS l").repartition(3)
    got = codes.coded(df, entries=entries, often=often, labels=labels).collect()
    same(got, plain_codes(exact_rows, 4, entries, 4, 1024))

"""Operators 11 to 13 against brute force, with odd rows."""
import hashlib
import html
import itertools
import os
import random
import re

import numpy as np
import pytest
from llm_fixtures import SF, empty_docs, odd_docs

from tallyframe.llm import filter_audit, html_blocks, html_extract, min_cut, registry, vector_codes
from tallyframe.sources.tables import read_table

# ---- 11 ----------------------------------------------------------------------------------


def failed_filters(text, first_id, doc_id):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    return out + ("E" if first_id is not None and (doc_id is None or doc_id > first_id) else "")


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = [(d, t or "", p or "") for d, t, p in docs]
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    parts = {}
    for d, t, p in docs:
        parts.setdefault(p, []).append((d, failed_filters(t, first.get(t), d)))
    out = {}
    for p, rows in parts.items():
        over_orders = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                over_orders[f] += len(here)
                out[p, "".join(order), step] = (len(left), len(here), sum(f in r[1] for r in gone), sum(r[1] == f for r in rows),
                                                sum(r[0] in good for r in here), sum(r[0] in toxic for r in here))
                gone = gone + here
        for (q, order, step), v in list(out.items()):
            if q == p and len(v) == 6:
                out[q, order, step] = (*v, over_orders[order[step - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_audit_equals_replaying_every_order(spark):
    rng = random.Random(5)
    long_text = " ".join(f"w{i}" for i in range(250))
    texts = [long_text, long_text + " #", long_text.upper(), "ab " * 300, "", None, " \n", "One two", "a|b", "x" * 100_000, "é" * 40 + "AB"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(150)]
    docs += [(None, long_text, "en"), (None, "only without id", "fr"), (None, "only without id", "fr"), (7, docs[7][1], "en"), (-3, long_text, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 2, True) for d in docs], "doc_id long, text string, lang string, failed int, n long, good boolean")
    lab = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, sha string")
    got = audited(filter_audit.audit(filter_audit.with_copies(filter_audit.failures(df), lab)))
    want = brute_audit(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs}) and got == want


def test_audit_of_odd_documents(spark):
    df = odd_docs(spark, ids_null=True)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audited(filter_audit.audit(filter_audit.with_copies(filter_audit.failures(df), lab)))
    assert got == brute_audit([(r.doc_id, r.text, r.lang) for r in df.collect()], [])
    assert filter_audit.audit(filter_audit.with_copies(filter_audit.failures(empty_docs(spark)), lab)).count() == 0


def test_potential_gives_shapley_values(spark):
    """A game of three players whose values are known: two equal ones and one that adds nothing."""
    from pyspark.sql import functions as F
    worth = [0, 6, 6, 6, 0, 6, 6, 6]
    row = spark.range(1).select(filter_audit.potential(F.array(*[F.lit(w).cast("long") for w in worth]), 3).alias("p")).first()
    assert [(row.p[7] - row.p[7 ^ bit]) / 6 for bit in (1, 2, 4)] == [3, 3, 0]


# ---- 12 ----------------------------------------------------------------------------------

LONG = "The long paragraph speaks of many things, as paragraphs do, and it ends with a proper full stop after enough words."
PAGES = {
    f"<body class='has-sidebar'><header><a href=/>Site</a><h2>Tagline of the site.</h2></header><nav><a href=1>One</a><a href=2>Two</a></nav>"
    f"<div class='page-with-sidebar'><main><h1>Title here</h1><p>{LONG}</p><p>Short.</p><ul><li>First point</li><li>Second point</li></ul>"
    f"<table><tr><td>a</td><td>b</td></tr></table><aside><p>{LONG}</p></aside><form><label>Mail</label><input><button>Send it</button></form>"
    f"<p>{LONG}</p></main><div id=sidebar><h3>Related</h3><p>{LONG}</p></div></div><section class='comments'><h3>Comments</h3>"
    f"<article class='comment'><p>{LONG} I say.</p></article><div><p>{LONG}</p></div></section><footer><p>&copy; 2024 {LONG}</p></footer></body>":
        ["Title here", LONG, "Short.", "First point", "Second point", "a b", LONG],
    f"<body><div id=menu><a href=1>One</a> | <a href=2>Two</a></div><div><div><h1>Title words</h1>{LONG}<br>{LONG}</div><div>{LONG}</div></div>"
    f"<div class='cookie-notice'>{LONG}</div><div>Copyright 2024 All rights reserved</div></body>": ["Title words", f"{LONG} {LONG}", LONG],
    f"{LONG} plain text &amp text &lt;b&gt; 1 < 2 <b>bold<i>x</b></i> end.": [f"{LONG} plain text & text <b> 1 < 2 boldx end."],
    f"<article><h1>T</h1><p>{LONG}<p>Next para with <a hre": ["T", LONG, "Next para with"],
    f"<article><header><h1>The title of it</h1><p>By Jane Doe</p></header><p>{LONG}</p><footer>Posted in: <a href=1>news</a></footer></article>":
        ["The title of it", "By Jane Doe", LONG],
    f"<article><p title=\"foo>{LONG}</p><p>{LONG}</p></article>": [LONG, LONG],
    f"<article><p hidden>{LONG} A</p><p style='display: none'>{LONG} B</p><div class=notice>{LONG} C</div>"
    f"<p>{LONG}<script>var x='<p>';</script> tail<!-- c > --> x</p></article>": [f"{LONG} tail x"],
    "<article><p>a&nbsp;b &#8212; c&#x2019;d \n\t e</p></article>": ["a b — c’d e"],
    f"<aside><article class=teaser><h3>Teaser</h3><p>{LONG}</p></article></aside><article><h1>Real</h1><p>{LONG} Real.</p></article>"
    f"<div class='advert'><p>{LONG}</p></div>": ["Real", f"{LONG} Real."],
    "": [], "<nav><a>x</a></nav>": [], "<p": [], "<!-- never closed <p>x</p>": [], "<script>var a = '<p>x</p>'": [],
}


def test_main_text_of_many_shapes():
    model = html_extract.log_odds({})
    for page, want in PAGES.items():
        assert html_extract.main_text(page, model)[0].split("\n") == (want or [""]), page[:200]


def test_pages_cut_off_anywhere():
    model = html_extract.log_odds({})
    page = max(PAGES, key=len)
    for n in range(0, len(page), 7):
        html_extract.main_text(page[:n], model)
    html_extract.main_text("<a '\">" * 2000 + "&#xD800;&#0;&#99999999;</p></div></>", model)


def test_large_and_deep_pages():
    model = html_extract.log_odds({})
    wide = "<article>" + "".join(f"<p>{LONG} {i}" for i in range(8000)) + "</article><footer>x</footer>"
    text = html_extract.main_text(wide, model)[0]
    assert text.count("\n") == 7999 and text.endswith("7999")
    deep = "<div>" * 20000 + f"<p>{LONG}" + "</div>" * 20000
    assert html_extract.main_text(deep, model)[0] == LONG


def test_minimum_cut_equals_enumeration():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        gains = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        net = min_cut.Network(n)
        for i, g in enumerate(gains):
            net.tie(i, g)
        for e in edges:
            net.join(*e)
        flow, side = net.flow(), net.source_side()

        def cost(kept):
            return sum(max(g, 0) if not k else max(-g, 0) for g, k in zip(gains, kept)) + sum(c for a, b, c in edges if kept[a] != kept[b])

        every = list(itertools.product([False, True], repeat=n))
        least = min(map(cost, every))
        assert flow == least == cost(side)
        assert sum(side) == max(sum(k) for k in every if cost(k) == least)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_extracts_the_articles_of_all_pages(spark):
    rows = {r.page_id: r for r in registry.QUERIES["op12_html_extract"](spark, SF).collect()}
    pages = read_table(spark, SF, "pages").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search("<article>(.*)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)


def test_extract_odd_rows(spark):
    rows = [(1, "u", "<article><p>text of it.</p></article>", "x", 1)] * 2 + [(None, None, None, None, None), (2, "v", "", "y", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.extract(df, html_extract.fit(df)).collect()
    assert sorted(map(str, got)) == sorted(map(str, [
        html_extract_row(1, "u", "text of it.", 11, 1, 1)] * 2 + [html_extract_row(None, None, "", 0, 0, 0), html_extract_row(2, "v", "", 0, 0, 0)]))
    none = df.where("false")
    assert html_extract.extract(none, html_extract.fit(none)).count() == 0


def html_extract_row(*values):
    from pyspark.sql import Row
    return Row("page_id", "url", "text", "n_chars", "n_blocks", "n_content")(*values)


def test_parser_closes_what_is_left_open():
    page = html_blocks.parse("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<div>y</div>z<a>l<a>m</a>")
    assert [b.text for b in page.blocks] == ["a", "b", "c", "d", "1 2", "3", "x", "y", "zlm"]
    assert page.blocks[-1].linked == 2


# ---- 13 ----------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale=1024):
    """rows: (vec_id, vector, label) of usable vectors."""
    ints = [(i, [int(np.floor(scale * x)) for x in v], lab) for i, v, lab in rows]
    order = lambda i: (i is None, i or 0)
    ids = sorted({i for i, _, _ in ints}, key=order)[:entries]
    start = [min(v for j, v, _ in ints if j == i) for i in ids]
    w = len(start[0]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in ints]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), a in zip(ints, near) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, lab, [k for _, k in a], sum(d for d, _ in a)) for (i, _, lab), a in zip(ints, assign())]
    return out, [c for b in books for e in b for c in e]


VECTORS = "vec_id long, embedding array<double>, label int, row long, codes string"


@pytest.mark.parametrize("block,spread", [(3, 2), (128, 400), (16, 4_000_000)])
def test_codes_equal_plain_k_means(spark, block, spread):
    rng = np.random.default_rng(block)
    rows = [(int(i), (rng.integers(-spread, spread + 1, 8) / 1024 + 0.0004).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(90)]
    rows += [(500 + i, rows[4][1], 1) for i in range(60)]                       # many copies of one vector
    rows += [(3, rows[7][1], 2), (3, rows[7][1], 2), (None, rows[8][1], None)]  # repeated ids, rows, and a null id
    odd = [(600, None, 1), (601, [], 1), (602, [1.0, None] * 4, 1), (603, [float("nan")] * 8, 1), (604, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + odd], VECTORS)
    coded, books = vector_codes.compress(df, 4, 12, 3, block=block)
    want, components = brute_codes(rows, 4, 12, 3)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.vec_id, r.label, r.codes, r.error) for r in coded.collect()), key=key) == sorted(want, key=key)
    assert [int(x) for x in vector_codes.books_text(books).split(",")] == components


def test_codes_of_no_rows_and_of_wrong_lengths(spark):
    none = spark.createDataFrame([], VECTORS)
    coded, books = vector_codes.compress(none)
    assert coded.count() == 0 and books == [] and coded.columns == ["row", "vec_id", "label", "codes", "error"]
    assert vector_codes.books_text(books) == "" and hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="multiple"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1, 1, "")], VECTORS))
    with pytest.raises(Exception, match="scaling"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, 1, "")], VECTORS))
    mixed = spark.createDataFrame([(i, [1.0] * (8 if i < 300 else 12), 1, 1, "") for i in range(400)], VECTORS)
    with pytest.raises(Exception, match="another length"):
        vector_codes.compress(mixed)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = vector_codes.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * dims))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlists_lose_no_nearest_entry():
    rng = np.random.default_rng(4)
    for _ in range(100):
        points, book = rng.integers(-20, 20, (9, 3)) + rng.integers(-30, 30, 3), rng.integers(-50, 50, (40, 3))
        near = vector_codes.shortlist(points.min(0), points.max(0), book)
        code, error = vector_codes.nearest(points, book[near])
        apart = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (near[code] == apart.argmin(1)).all() and (error == apart.min(1)).all()
    big = np.array([[1 << 23, -(1 << 23)], [5, 7]])
    assert vector_codes.nearest(big, np.array([[1, 2], [(1 << 23) - 1, -(1 << 23)]]))[1].tolist() == [1, 41]

"""Operator 12, HTML extraction: a minimum cut separates a page's main text from what stands around it.

A page is parsed into text blocks (``html_blocks``). A classifier gives each block a score, the log odds of being
content: fixed evidence of the elements around it (their names, roles, classes and ids) and a naive Bayes model of
the text itself (words, share of links, sentence end, signs of ownership). The model is trained here: blocks
inside elements whose names leave no doubt are its examples, counted over all pages, with stated prior counts, so
that it is defined without any. Then every page becomes a network (``min_cut``): a score binds its block to the
content or to the boilerplate terminal with that capacity; neighbours in the page are joined, the more strongly
the fewer steps lie between them in the element tree, and each element below the body joins what it directly
holds. The maximum flow's cut labels the blocks, and content blocks are joined in page order by one line feed.

Pages are independent rows: nothing is shuffled but the model's counts, a dozen rows from each task. A page with its
network is held in memory; work is linear in the page but for the flow.

Defined cases: null or empty html, or html without content, gives an empty text; a null id or url is returned as it
is; rows that repeat are extracted each; a page cut off anywhere is extracted as far as it goes; of several least
cuts that with the most content counts. Line breaks within a block, and cells of a row, are white space; all
white space that Unicode knows counts. An empty table gives no rows. Other columns are not looked at.
"""
from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import read_table
from .html_blocks import Block, Element, Page, attributes, parse
from .min_cut import Network

UNIT = 16           # capacity of one unit of evidence
NEIGHBOURS = 48     # capacity between neighbours one step apart; two steps have half of it, and so on
TOGETHER = 16       # capacity between an element and what it directly holds
MOST = 2.5          # evidence of one property of the text at most
PAGES_A_BATCH = 512
OUT = "page_id long, url string, text string, n_chars long, n_blocks int, n_content int"
COUNTS = "property int, value int, content long, boilerplate long"

# Evidence of elements. Positive evidence counts once, the strongest; negative evidence adds up.
FOR_TAG = {"article": 5.0, "main": 4.0}
AGAINST_TAG = {"nav": -8.0, "menu": -8.0, "aside": -8.0, "footer": -7.0, "header": -6.0, "form": -8.0, "dialog": -8.0, "select": -8.0,
               "fieldset": -6.0, "noscript": -8.0, "search": -8.0, "head": -8.0}
INSIDE_TAG = {"header": -1.0, "footer": -8.0}  # instead of the above, inside an article or main element
ROLES = {"main": 4.0, "article": 4.0, "navigation": -8.0, "banner": -6.0, "contentinfo": -7.0, "complementary": -8.0, "search": -8.0,
         "dialog": -8.0, "alertdialog": -8.0, "alert": -8.0, "menu": -8.0, "menubar": -8.0, "form": -8.0, "toolbar": -8.0}
FOR_WORDS = {w: 3.0 for w in "article articles post entry story content main body text page maincontent articlebody".split()}
AGAINST_WORDS = {w: -8.0 for w in (
    "ad ads adv advert adverts advertisement advertisements advertising adslot adbox sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup signin login register paywall share sharing social "
    "related recommended recommendations trending popular teaser teasers widget widgets comment comments commentlist disqus replies reply "
    "respond discussion feedback reviews copyright disclaimer toolbar search searchbox form banner masthead alert alerts announcement "
    "topbar taboola outbrain").split()} | {w: -5.0 for w in "header footer foot legal hidden skip tags tagcloud colophon noprint".split()}
READERS = frozenset("comment comments commentlist disqus replies reply respond discussion reviews".split())

# Prior counts of (content, boilerplate) blocks by value of each property of the text.
PRIOR = {
    "words": ((20, 40), (20, 30), (25, 15), (30, 10), (45, 5)),   # fewer than 3, 6, 12, 25 words; more
    "links": ((120, 50), (15, 10), (4, 15), (1, 25)),             # share of characters in links: none, < 0.3, < 0.7, more
    "ending": ((100, 30), (40, 70)),                              # a sentence ends the block, or does not
    "owner": ((138, 80), (2, 20)),                                # without or with a sign of ownership
}
WORD_STEPS, LINK_STEPS = (3, 6, 12, 25), (0.0, 0.3, 0.7)
_ENDING = re.compile("[.!?…:;][\"'»“”’)\\]]*$")
_OWNER = re.compile("[©®]|\\(c\\) ?[12][0-9]{3}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.I)
_NAMES = re.compile("[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")

Model = Sequence[Sequence[float]]


# ---- the classifier ----------------------------------------------------------------------


def _words(value: str) -> set[str]:
    """The words of a class or id: as written between marks, and cut at capitals."""
    whole = {w.lower() for w in re.split("[^A-Za-z]+", value) if w}
    return whole | {w.lower() for w in _NAMES.findall(value)}


def _own_evidence(e: Element, inside: bool) -> tuple[float, float, float, bool]:
    """(for, against by name or role, against by class or id, whether these name readers' comments)."""
    good, named = FOR_TAG.get(e.name, 0.0), (INSIDE_TAG if inside else {}).get(e.name, AGAINST_TAG.get(e.name, 0.0))
    if not e.attributes or e.name in ("html", "body"):
        return good, named, 0.0, False
    a = attributes(e.attributes)
    role = ROLES.get(a.get("role", "").strip().lower(), 0.0)
    good, named = max(good, role), min(named, role)
    style = a.get("style", "").replace(" ", "").lower()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        named = min(named, -8.0)
    words = _words(f"{a.get('class', '')} {a.get('id', '')}")
    against = min((AGAINST_WORDS[w] for w in words if w in AGAINST_WORDS), default=0.0)
    if not against:
        good = max([good, *(FOR_WORDS[w] for w in words if w in FOR_WORDS)])
    return good, named, against, bool(words & READERS)


def structure_scores(page: Page) -> list[float]:
    """Evidence of the elements around it, for every block."""
    elements, n = page.elements, len(page.elements)
    chars = [0] * n
    for b in page.blocks:
        chars[b.element] += len(b.text)
    for i in range(n - 1, 0, -1):
        chars[elements[i].parent] += chars[i]
    inside = [False] * n
    own = [(0.0, 0.0, 0.0, False)] * n
    for i in range(1, n):
        inside[i] = inside[elements[i].parent] or elements[elements[i].parent].name in ("article", "main")
        own[i] = _own_evidence(elements[i], inside[i])
    # a wrapper of the main part is not judged by its own class; comments are
    for least in (4.0, 0.5):
        parts = [i for i in range(1, n) if own[i][0] >= least and not own[i][1] and not own[i][2] and not inside[i]]
        if parts:
            break
    if parts:
        i = max(parts, key=lambda k: (elements[k].name == "main", chars[k], -k))
        while i > 0:
            own[i] = (own[i][0], own[i][1], own[i][2] if own[i][3] else 0.0, own[i][3])
            i = elements[i].parent
    good, bad = [0.0] * n, [0.0] * n
    for i in range(1, n):
        up = elements[i].parent
        good[i] = max(good[up], own[i][0] if bad[up] > -5 else 0.0)
        bad[i] = max(-16.0, bad[up] + min(own[i][1], own[i][2]))
    return [good[b.element] + bad[b.element] for b in page.blocks]


def properties(b: Block) -> tuple[int, ...]:
    """The value of each property of a block's text, in the order of ``PRIOR``."""
    words, share = b.text.count(" ") + 1, min(1.0, (b.linked + b.controls) / len(b.text))
    return (sum(words >= s for s in WORD_STEPS), sum(share > s for s in LINK_STEPS),
            0 if _ENDING.search(b.text[-8:]) else 1, 1 if _OWNER.search(b.text) else 0)


def log_odds(counts: dict[tuple[int, int], tuple[int, int]]) -> Model:
    """The model from counts of (content, boilerplate) blocks by property and value."""
    model = []
    for k, prior in enumerate(PRIOR.values()):
        rows = [(c + counts.get((k, v), (0, 0))[0], x + counts.get((k, v), (0, 0))[1]) for v, (c, x) in enumerate(prior)]
        content, other = sum(c for c, _ in rows), sum(x for _, x in rows)
        model.append([max(-MOST, min(MOST, math.log(c / content) - math.log(x / other))) for c, x in rows])
    return model


def _count(batches):
    """Pages -> how often each value stands in blocks that are content, or not, beyond doubt."""
    counts: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        for source in batch.column(0):
            page = parse(source.as_py() or "")
            for b, score in zip(page.blocks, structure_scores(page)):
                if score >= 3 or score <= -5:
                    for key in enumerate(properties(b)):
                        counts.setdefault(key, [0, 0])[score < 0] += 1
    rows = [(k, v, *c) for (k, v), c in counts.items()]
    columns = list(zip(*rows)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                     names=["property", "value", "content", "boilerplate"])


def fit(pages: DataFrame, html_col: str = "html") -> Model:
    """The model of the text, from the blocks of all pages."""
    ship_package(pages.sparkSession)
    counts = pages.select(pages[html_col].cast("string").alias("html")).mapInArrow(_count, COUNTS)
    rows = counts.groupBy("property", "value").agg(F.sum("content"), F.sum("boilerplate")).collect()
    return log_odds({(k, v): (c, x) for k, v, c, x in rows})


# ---- the cut -----------------------------------------------------------------------------


def steps_between(elements: list[Element], a: int, b: int) -> int:
    """Steps in the element tree from one element to another; 1 for the same."""
    steps = 1
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def label(page: Page, scores: Sequence[float]) -> list[bool]:
    """Whether each block is content: the source side of the page's minimum cut."""
    elements, blocks = page.elements, page.blocks
    node = {}  # elements that join several blocks
    holds = [0] * len(elements)
    for b in blocks:
        holds[b.element] += 1
    for i in range(len(elements) - 1, 0, -1):
        holds[elements[i].parent] += holds[i] > 0
    top = {i for i, e in enumerate(elements) if i == 0 or e.name in ("html", "body")}
    for i, h in enumerate(holds):
        if h > 1 and i not in top:
            node[i] = len(blocks) + len(node)
    net = Network(len(blocks) + len(node))

    def joined(i: int) -> int:
        while i not in node and i not in top:
            i = elements[i].parent
        return node.get(i, -1)

    for k, (b, score) in enumerate(zip(blocks, scores)):
        net.tie(k, round(UNIT * score))
        if k:
            net.join(k - 1, k, NEIGHBOURS // steps_between(elements, blocks[k - 1].element, b.element))
        if (up := joined(b.element)) >= 0:
            net.join(k, up, TOGETHER)
    for i, n in node.items():
        if (up := joined(elements[i].parent)) >= 0:
            net.join(n, up, TOGETHER)
    net.flow()
    return net.source_side()[:len(blocks)]


def scores_of(page: Page, model: Model) -> list[float]:
    return [s + sum(m[v] for m, v in zip(model, properties(b))) for b, s in zip(page.blocks, structure_scores(page))]


def main_text(source: str, model: Model) -> tuple[str, int, int]:
    """(text, number of blocks, number of content blocks) of a page."""
    page = parse(source)
    kept = [b.text for b, keep in zip(page.blocks, label(page, scores_of(page, model))) if keep]
    return "\n".join(kept), len(page.blocks), len(kept)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_content of every page."""
    ship_package(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), PAGES_A_BATCH):
                part = batch.slice(start, PAGES_A_BATCH)
                rows = [main_text(source.as_py() or "", model) for source in part.column(2)]
                texts, blocks, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(blocks, pa.int32()), pa.array(kept, pa.int32())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, OUT)


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))

"""Main text of web pages from flat text blocks and a decision tree (operator 5).

A page is cut into flat blocks at block-level tags. Each block gets its number of words, its link
density, both figures of its neighbours, and where it stands (inside an article, inside a container that tags,
roles or class names mark as boilerplate, on a page that has most of its other text in articles). A decision tree grown on the small labelled table below classifies blocks;
the blocks it keeps are joined in page order.

Defined cases: null or empty html gives an empty text; unclosed and wrongly nested tags are closed by their
containers or by the end; null ids and urls and repeated rows pass through; an empty table gives an empty
result; other columns are left alone. Whole pages are read; nothing is capped.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*[^>]*)(?:>|\Z)", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "button", "object", "head"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: Names that always mark boilerplate, names that often do, and parts of names that say nothing.
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr popup modal newsletter signup login "
    "sidebar sidenav nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments reply replies respond disqus pagination pager copyright disclaimer contentinfo complementary".split()
)
HINT_WORDS = set("sponsor promo promotion banner notice subscribe subscription side menu share sharing social related recommended widget form search alert".split())
PLAIN_WORDS = set("box bar list wrapper wrap container section block area top bottom left right item items link links button buttons icon icons inner outer col row head header body content main site page the and of mobile desktop sticky fixed primary secondary inline text title module panel region group js is has".split())
#: Classes of an article that is a comment or a teaser; not those that say whether it has comments.
ARTICLE_WORDS = set("comment comments reply replies respond teaser teasers related recommended promo sponsored advert advertisement ad ads".split())
ARTICLE_STATES = re.compile(r"^(?:has|no|with|without|allow)\b|\b(?:open|closed|count|enabled|disabled|on|off)$")
HINT = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_boiler", "has_article")
#: Shapes of blocks seen on pages without an article element: the first six features, then 1 for main text.
SHAPES = (
    (40, 0.0, 12, 0.0, 55, 0.0, 1),
    (30, 0.0, 25, 0.0, 40, 0.0, 1),
    (18, 0.1, 45, 0.0, 22, 0.0, 1),
    (12, 0.0, 6, 0.0, 50, 0.0, 1),
    (75, 0.05, 2, 1.0, 3, 1.0, 1),
    (8, 0.0, 0, 0.0, 90, 0.0, 1),
    (4, 0.0, 45, 0.0, 38, 0.0, 1),
    (2, 0.0, 35, 0.0, 60, 0.0, 1),
    (120, 0.0, 9, 0.0, 0, 0.0, 1),
    (25, 0.2, 30, 0.0, 40, 0.0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0),
    (3, 1.0, 45, 0.0, 60, 0.1, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0),
    (15, 0.9, 10, 0.8, 4, 1.0, 0),
    (5, 0.8, 60, 0.0, 3, 1.0, 0),
    (3, 0.0, 4, 0.7, 2, 0.0, 0),
    (9, 1.0, 3, 0.0, 2, 1.0, 0),
    (1, 0.0, 1, 1.0, 3, 0.0, 0),
    (2, 1.0, 2, 1.0, 0, 0.0, 0),
    (2, 1.0, 40, 0.0, 2, 1.0, 0),
    (6, 1.0, 30, 0.0, 35, 0.0, 0),
    (30, 0.9, 50, 0.0, 20, 0.0, 0),
    (2, 1.0, 0, 0.0, 45, 0.0, 0),
)
#: Where a block can stand: in an article, in boilerplate (1: by names that often mark it, 2: for sure), most text of the page in articles.
STANDS = tuple((article, boiler, has) for article in (1, 0) for boiler in (2, 1, 0) for has in (1, 0))


def _label(shape, article: int, boiler: int, has_article: int) -> int:
    """In an article that is the page's text short blocks count too, but not links; beside it, and under doubtful names, only long text does."""
    words, links, label = shape[0], shape[1], shape[6]
    if boiler == 2:
        return 0
    if boiler == 1:
        return int(label and words >= 25 and article >= has_article)
    if not has_article:
        return label
    return int(links < 0.5) if article else int(label and words >= 25)


#: The labelled table: every shape in every place.
LABELLED = tuple((*shape[:6], *place, _label(shape, *place)) for place in STANDS for shape in SHAPES)


def grow(rows: np.ndarray, depth: int = 8):
    """A CART tree by Gini impurity: (feature, threshold, left, right), or a leaf's label."""
    y = rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= t
            cost = sum(len(s) * (1 - s.mean() ** 2 - (1 - s.mean()) ** 2) for s in (y[left], y[~left]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    left = rows[:, f] <= t
    return f, float(t), grow(rows[left], depth - 1), grow(rows[~left], depth - 1)


def classify(tree, block) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if block[f] <= t else high
    return tree


def _marked(tag: str, attributes: str, in_article: bool) -> int:
    """2: boilerplate for sure; 1: by its names perhaps; 0: not. A name counts if all of its parts do, but for those that say nothing."""
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return 2
    if not attributes or tag in ("main", "body", "html"):
        return 0
    found = 2 if HIDDEN.search(attributes) else 0
    for m in HINT.finditer(attributes):
        if tag == "article":
            names = [re.sub(r"[^a-z0-9]+", " ", n).strip() for n in (m[1] or m[2] or m[3] or "").lower().split()]
            if any(ARTICLE_WORDS.intersection(n.split()) and not ARTICLE_STATES.search(n) for n in names):
                return 2
            continue
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = set(re.split(r"[^a-z0-9]+", name)) - PLAIN_WORDS - {""}
            if parts and parts <= BOILER_WORDS | HINT_WORDS:
                found = max(found, 2 if parts & BOILER_WORDS else 1)
    return found


def blocks(page: str | None) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, in an article, in boilerplate: 2 for sure, 1 perhaps) of each flat block with text."""
    page = page or ""
    out, text, linked = [], [], 0
    stack: list[tuple[str, int]] = []
    in_link, article, boiler, at = False, 0, [0, 0, 0], 0

    def flush():
        nonlocal text, linked
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                n = len(whole.split())
                out.append((whole, n, min(1.0, linked / n), int(article > 0), 2 if boiler[2] else int(boiler[1] > 0)))
        text, linked = [], 0

    def add(s: str):
        nonlocal linked
        text.append(s)
        if in_link:
            linked += len(s.split())

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                flush_here = tag in ("head", "title")
                end = re.compile(rf"</{tag}\s*>|\Z" if tag != "head" else r"</head\s*>|<body\b|\Z", re.I).search(page, at)
                at = end.start() if tag == "head" and end[0].lower().startswith("<body") else end.end()
                if flush_here:
                    flush()
            continue
        if tag == "a":
            in_link = not closing
        elif tag in ("br", "wbr"):
            add(" ")
        if tag not in BLOCKS:
            if not closing and tag in ("span", "label", "small") and _marked(tag, m[3], article > 0) == 2:
                stack_tag = re.compile(rf"</{tag}\s*>|(?=<(?:/?(?:{'|'.join(sorted(BLOCKS))}))\b)|\Z", re.I).search(page, at)
                at = stack_tag.end()
            continue
        flush()
        in_link = False
        if not closing and tag == "p" and _marked(tag, m[3], article > 0) == 2:
            end = re.compile(rf"</p\s*>|(?=<(?:/?(?:{'|'.join(sorted(BLOCKS))}))\b)|\Z", re.I).search(page, at)
            at = end.end()
        elif tag in CONTAINERS:
            if not closing:
                mark = _marked(tag, m[3], article > 0)
                stack.append((tag, mark))
                boiler[mark] += 1
                article += tag in ("article", "main")
            elif any(t == tag for t, _ in stack):
                while True:
                    t, mark = stack.pop()
                    boiler[mark] -= 1
                    article -= t in ("article", "main")
                    if t == tag:
                        break
    flush()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    has = int(2 * sum(b[1] for b in found if b[3] and b[4] < 2) > sum(b[1] for b in found if b[4] < 2))
    none = ("", 0, 0.0, 0, 0)
    kept = []
    for i, (text, n, links, article, boiler) in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        if classify(tree, (n, links, before[1], before[2], after[1], after[2], article, boiler, has)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """``keep`` columns with text."""
    tree = grow(np.array(LABELLED, float))
    keep = [c for c in dict.fromkeys(keep) if c != "text"]
    d = pages.select(*dict.fromkeys([*keep, column]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, column):
                texts = [main_text(p, tree) for p in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    return d.mapInArrow(run, d.select(*keep).schema.add("text", "string"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

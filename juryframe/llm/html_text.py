"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are nodes with a label, content or not. Each node has a potential from its own features
(tag, class words, text length, link share, stops), each parent and child a potential from their labels. Sum-product
message passing, once upward and once downward, gives exact marginals; blocks above one half are the main text. Node
weights are a logistic regression and edge potentials smoothed label counts, learned from a bounded sample of pages
that say themselves where their article is (an article or main element); what lies in a menu, footer or the like inside
it is labelled as not content.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from juryframe.llm.common import batches, prepare

SAMPLE_PAGES = 400
ROUNDS, RATE, DECAY = 300, 0.5, 1e-3

# Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template head title iframe textarea select button option".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr br math svg object canvas".split())
#: All elements inside these stand in the line, but for those of CLOSES_P.
DRAWN = {"math", "svg"}
#: What may stand in a head; anything else ends it.
HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WALLS = set("ul ol dl table article section div body".split())
GROUPS = [{"article", "main"}, {"nav", "menu"}, {"footer"}, {"header"}, {"aside"}, {"form", "fieldset", "dialog"}, {"p", "blockquote", "pre", "figcaption"},
          {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"td", "th"}, {"body"}]
BAD_TAGS = set().union(*GROUPS[1:6])
# Parts of class names, ids and roles that mark what is not content, and what is.
BAD = re.compile(r"(^|[\s_-])(ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|nav\w*|menu|breadcrumbs?|footer|header|masthead|sidebar|side|widget|comments?|respond|reply|"
                 r"share|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|pagination|contentinfo|complementary|navigation|search)($|[\s_-])", re.I)
GOOD = re.compile(r"(^|[\s_-])(article\w*|content|main|post|entry|story|body|text)($|[\s_-])", re.I)
N_FEATURES = len(GROUPS) + 9


class Page(HTMLParser):
    """Block elements of a page: parent, tag, marks, and texts in page order as (node, text, in a link)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.marks, self.texts = ["body"], [-1], [""], []
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.unseen = self.links = self.drawn = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            self.close_above("head")
            return
        if tag not in HEAD and self.stack[-1][0] == "head":
            self.pop()
        if tag in CLOSES_P:
            self.close("p", WALLS - {"div", "section", "article"})
        if tag in SIBLINGS:
            for other in SIBLINGS[tag]:
                self.close(other, {"ul", "ol", "dl", "table"})
        if tag in VOID:
            if tag == "br":
                self.texts.append((self.stack[-1][1], " ", False))
            elif tag == "hr":
                self.new(tag, "")
            return
        node = self.stack[-1][1]
        if tag not in INLINE and (not self.drawn or tag in CLOSES_P):
            given = dict(attrs)
            node = self.new(tag, " ".join(given.get(k) or "" for k in ("class", "id", "role")) + (" popup" if "hidden" in given or given.get("aria-hidden") == "true" else ""))
        self.stack.append((tag, node))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"
        self.drawn += tag in DRAWN

    def new(self, tag: str, mark: str) -> int:
        self.tags.append(tag)
        self.parents.append(self.stack[-1][1])
        self.marks.append(mark)
        self.texts.append((self.stack[-1][1], None, False))
        return len(self.tags) - 1

    def pop(self) -> None:
        tag, node = self.stack.pop()
        self.unseen -= tag in UNSEEN
        self.links -= tag == "a"
        self.drawn -= tag in DRAWN
        if node != self.stack[-1][1]:
            self.texts.append((self.stack[-1][1], None, False))
        elif tag == "text":
            self.texts.append((node, " ", False))

    def close_above(self, tag: str) -> None:
        if any(t == tag for t, _ in self.stack):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def close(self, tag: str, walls: set[str]) -> None:
        for t, _ in reversed(self.stack):
            if t == tag:
                self.close_above(tag)
                return
            if t in walls:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and len(self.stack) > 1:
            self.close_above(tag)

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self.pop()
        if not self.unseen:
            self.texts.append((self.stack[-1][1], data, self.links > 0))


def read(html: str) -> tuple[Page, list[tuple[int, str]], np.ndarray]:
    """(page, blocks as (node, text), features of the nodes). A block ends where a block element starts or ends."""
    page = Page()
    page.feed(html)
    HTMLParser.close(page)
    size, linked, stops = np.zeros(len(page.tags)), np.zeros(len(page.tags)), np.zeros(len(page.tags))
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    node = -1
    for at, text, link in page.texts + [(-1, None, False)]:
        if text is None or at != node:
            if whole := " ".join("".join(held).split()):
                blocks.append((node, whole))
            held, node = [], at
        if text is not None:
            held.append(text)
            n = len(text.strip())
            size[at] += n
            linked[at] += n if link else 0
            stops[at] += text.count(".") + text.count(",")
    below, below_linked = size.copy(), linked.copy()
    for v in range(len(page.tags) - 1, 0, -1):
        below[page.parents[v]] += below[v]
        below_linked[page.parents[v]] += below_linked[v]
    table = np.zeros((len(page.tags), N_FEATURES))
    for v, (tag, mark) in enumerate(zip(page.tags, page.marks)):
        for i, group in enumerate(GROUPS):
            table[v, i] = tag in group
        k = len(GROUPS)
        bad = bool(BAD.search(mark))
        table[v, k:] = (1, bad, not bad and bool(GOOD.search(mark)), math.log1p(size[v]) / 5, linked[v] / size[v] if size[v] else 0, math.log1p(stops[v]) / 3,
                        math.log1p(below[v]) / 5, below_linked[v] / below[v] if below[v] else 0, not below[v])
    return page, blocks, table


def own_labels(page: Page) -> np.ndarray | None:
    """1 for nodes of the article that lie in nothing marked as not content; None for a page that names no article."""
    if not any(t in GROUPS[0] for t in page.tags):
        return None
    out, barred = np.zeros(len(page.tags), int), np.zeros(len(page.tags), bool)
    for v in range(1, len(page.tags)):
        up = page.parents[v]
        barred[v] = barred[up] or (page.tags[v] in BAD_TAGS) or bool(BAD.search(page.marks[v]))
        out[v] = int((out[up] or page.tags[v] in GROUPS[0]) and not barred[v])
    return out


# Weights before training, by group, then by the further features.
PRIOR = np.array([4, -10, -10, -10, -10, -10, 1, 1, 0, 0, -2] + [-1, -10, 2, 0.5, -3, 0.5, 0.2, -2, -0.5], float)
#: No edge weighs less than this, so that a node's own signs can overrule a transition never seen in training.
FLOOR = np.array([[-6.0, -6.0], [-3.0, -6.0]])


def train(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(node weights, log edge potentials [child names an article, parent label, child label]).

    Weights are drawn towards PRIOR, where they stay if no page is labelled or a feature is never seen.
    """
    x, y, edges = [], [], np.ones((2, 2, 2))
    for html in pages:
        page, _, table = read(html)
        labels = own_labels(page)
        if labels is not None:
            x.append(table)
            y.append(labels)
            np.add.at(edges, (table[1:, 0].astype(int), labels[page.parents[1:]], labels[1:]), 1)
    weights = PRIOR.copy()
    if x:
        features, target = np.concatenate(x), np.concatenate(y)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
            weights = weights + RATE * (features.T @ (target - p) / len(target) - DECAY * (weights - PRIOR))
    return weights, np.maximum(np.log(edges / edges.sum(2, keepdims=True)), FLOOR)


def marginals(parents: list[int], unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """P(label 1) of each node by sum-product; unary[v] is the log odds of label 1, edge[v] the potentials of the edge
    to its parent, parents come before children."""
    n = len(parents)
    own = np.stack([np.zeros(n), unary], 1)
    up, message = own.copy(), np.zeros((n, 2))
    for v in range(n - 1, 0, -1):
        message[v] = np.logaddexp(edge[v, :, 0] + up[v, 0], edge[v, :, 1] + up[v, 1])
        up[parents[v]] += message[v]
    full = up.copy()
    for v in range(1, n):
        above = full[parents[v]] - message[v]
        full[v] = up[v] + np.logaddexp(above[0] + edge[v, 0], above[1] + edge[v, 1])
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))


def main_text(html: str, model: tuple[np.ndarray, np.ndarray]) -> str:
    page, blocks, table = read(html)
    content = marginals(page.parents, table @ model[0], model[1][table[:, 0].astype(int)])
    return "\n".join(text for node, text in blocks if content[node] > 0.5)


def fit(pages: DataFrame, html: str = "html", size: int = SAMPLE_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """The model from at most `size` pages with an article or main element, those with the least hashes."""
    some = pages.select(F.col(html).alias("h")).where(F.col("h").rlike("(?i)<(article|main)[ >]")).orderBy(F.xxhash64("h"), "h").limit(size)
    return train([r.h for r in some.toLocalIterator()])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null or empty pages and pages of no main text give an empty text.

    Null ids and repeated rows are read like others.
    """
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(fit(pages, html) if model is None else model)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(source):
        for batch in source:
            for page, link, body in zip(*(c.to_pylist() for c in batch.columns)):
                text = main_text(body or "", shared.value)
                yield page, link, text, len(text)

    return pages.select(F.col(page_id).cast("long"), F.col(url), F.col(html)).mapInArrow(lambda source: batches(rows(source), schema, 512), "page_id long, url string, text string, n_chars long")

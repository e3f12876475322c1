"""Main text of web pages: a tree of content labels over the DOM.

Every element is content or not. What an element is like (its tag, words of its class and
id, how much of its text stands in links, how long and how punctuated it is) gives a
potential for its own label; parent and child have a potential for agreeing, by the kind
of child. On a tree, sum-product passing is exact: messages from the leaves to the root
and back give the probability of each element's label given the whole page. Weights are
learnt from labelled pages by gradient ascent on their likelihood, whose gradient is the
difference between what the labels say and what the marginals expect.

The text of an element is kept when it is more likely content than not. Blocks of a page
come in page order, white space inside them as one space, joined by one space.

Labelled pages are few and bounded (``MAX_LABELLED``); fitting them is the driver's only
work. Pages are read row by row in batches, without a shuffle. Null and empty pages have
no text. Every row gives one row, also repeated ones; ids are kept as they are, null ones
too. An element that is exactly as likely content as not is none. Only the named columns
are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridestats.llm.dom import INLINE, Node, parse

MAX_LABELLED = 400

_TAGS = ("article", "main", "section", "p", "h", "li", "list", "div", "inline", "a", "nav", "header", "footer", "aside", "form", "button",
         "table", "quote", "body", "other")
_GROUP = {**{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "td": "table", "th": "table",
          "tr": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "pre": "quote", "code": "quote", "fieldset": "form",
          "input": "form", "menu": "nav", "html": "body", "#root": "body", "head": "other", "figure": "section", "figcaption": "section"}
# Words of classes, ids and roles (fixed values): of page furniture, of readers' comments, of articles.
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|header|foot\w*|side\w*|ads?|advert\w*|sponsor\w*|banner\w*|promo\w*|cookie\w*|consent\w*|notice\w*|alert\w*|"
    r"popup\w*|modal\w*|breadcrumb\w*|share\w*|social\w*|related\w*|recommend\w*|subscribe\w*|newsletter\w*|login\w*|search\w*|widget\w*|"
    r"copyright|toolbar\w*|pager?|pagination|tags?|meta|skip\w*|form\w*|gdpr|privacy|complementary|contentinfo|navigation|topbar|masthead)(?:$|[\s_-])")
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?\w*|disqus\w*|repl(?:y|ies)|respond|discussion|reader-?\w*|feedback)(?:$|[\s_-])")
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|post\w*|entry\w*|content\w*|story\w*|main\w*|body\w*|text\w*|prose|blog\w*)(?:$|[\s_-])")
_SHAPES = ("furniture", "comments", "article words", "links", "no text", "short", "long", "ended", "bias")
FEATURES = (*_TAGS, *_SHAPES)


def _group(tag: str) -> str:
    group = _GROUP.get(tag, tag)
    return group if group in _TAGS else "inline" if tag in INLINE else "other"


_TAG_NUMBER = {t: i for i, t in enumerate(_TAGS)}


@dataclass
class Page:
    nodes: list[Node]
    parent: np.ndarray  # number of the parent; the root's is -1
    x: np.ndarray  # features
    kind: np.ndarray  # of the edge to the parent: 0 block, 1 inline


def featured(nodes: list[Node]) -> Page:
    n = len(nodes)
    parent = np.fromiter((v.parent.number if v.parent else -1 for v in nodes), np.int64, n)
    words, linked, ends = [0] * n, [0] * n, [0] * n
    for v in nodes:
        for part in v.parts:
            if type(part) is str:
                w = len(part.split())
                words[v.number] += w
                if w:
                    ends[v.number] += part.count(".") + part.count("!") + part.count("?")
    for i in range(n - 1, 0, -1):  # subtrees: children come after their parents
        if nodes[i].tag == "a":
            linked[i] = words[i]
        p = parent[i]
        words[p] += words[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
    x = np.zeros((n, len(FEATURES)))
    at = len(_TAGS)
    for i, v in enumerate(nodes):
        x[i, _TAG_NUMBER[_group(v.tag)]] = 1
        names = v.names
        if names:
            x[i, at] = bool(_FURNITURE.search(names))
            x[i, at + 1] = bool(_COMMENTS.search(names))
            x[i, at + 2] = bool(_ARTICLE.search(names))
    words, linked, ends = np.array(words), np.array(linked), np.array(ends)
    x[:, at + 3] = linked / np.maximum(words, 1)
    x[:, at + 4] = words == 0
    x[:, at + 5] = (words > 0) & (words < 5)
    x[:, at + 6] = words >= 40
    x[:, at + 7] = (ends > 0) & (words >= 5)
    x[:, at + 8] = 1
    kind = np.fromiter((v.tag in INLINE for v in nodes), np.int64, n)
    return Page(nodes, parent, x, kind)


@dataclass(frozen=True)
class Weights:
    """unary: per feature, for content; pair: per kind of edge, parent's and child's label."""

    unary: np.ndarray
    pair: np.ndarray


def marginals(page: Page, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node, and of each edge (but the root's) the four joint probabilities."""
    n, parent = len(page.parent), page.parent.tolist()
    own = (page.x @ weights.unary).tolist()
    pair = np.exp(weights.pair).tolist()
    kind = page.kind.tolist()
    # Upward: belief of a node's subtree, and the message to its parent, both scaled to 1.
    exp = np.exp(-np.abs(own))
    belief = [[1.0, e] if s < 0 else [e, 1.0] for s, e in zip(own, exp.tolist())]
    up = [None] * n
    for i in range(n - 1, 0, -1):
        b0, b1 = belief[i]
        t = pair[kind[i]]
        m0, m1 = t[0][0] * b0 + t[0][1] * b1, t[1][0] * b0 + t[1][1] * b1
        s = m0 + m1
        m0, m1 = m0 / s, m1 / s
        up[i] = m0, m1
        p = belief[parent[i]]
        p0, p1 = p[0] * m0, p[1] * m1
        s = p0 + p1
        p[0], p[1] = p0 / s, p1 / s
    # Downward: what the rest of the page says to a node.
    out, joint = [0.0] * n, np.zeros((n, 2, 2))
    full = belief
    s = full[0][0] + full[0][1]
    out[0] = full[0][1] / s
    for i in range(1, n):
        p, (m0, m1), t = full[parent[i]], up[i], pair[kind[i]]
        r0, r1 = p[0] / max(m0, 1e-300), p[1] / max(m1, 1e-300)  # the parent without this child
        b0, b1 = belief[i]
        j00, j01, j10, j11 = r0 * t[0][0] * b0, r0 * t[0][1] * b1, r1 * t[1][0] * b0, r1 * t[1][1] * b1
        s = j00 + j01 + j10 + j11
        joint[i] = ((j00 / s, j01 / s), (j10 / s, j11 / s))
        c0, c1 = (j00 + j10) / s, (j01 + j11) / s
        full[i] = [c0, c1]
        out[i] = c1
    return np.array(out), joint


def fit(pages: Sequence[tuple[Page, np.ndarray]], rounds: int = 150, rate: float = 0.5, decay: float = 0.001) -> Weights:
    """Weights from pages with the label (0, 1; -1: unknown) of each of their nodes."""
    if len(pages) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled pages")
    unary, pair = np.zeros(len(FEATURES)), np.zeros((2, 2, 2))
    steps = np.zeros(len(FEATURES)), np.zeros((2, 2, 2))
    for _ in range(rounds):
        g_unary, g_pair = -decay * unary * len(pages), -decay * pair * len(pages)
        for page, label in pages:
            p, joint = marginals(page, Weights(unary, pair))
            known = label >= 0
            size = max(1, known.sum()) ** 0.5  # long pages count for more, but not in full
            g_unary += page.x[known].T @ (label[known] - p[known]) / size
            both = np.flatnonzero(known[1:] & known[page.parent[1:]]) + 1
            kinds = page.kind[both]
            np.add.at(g_pair, (kinds, label[page.parent[both]], label[both]), 1 / size)
            for k in (0, 1):
                g_pair[k] -= joint[both[kinds == k]].sum(axis=0) / size
        for value, gradient, step in ((unary, g_unary, steps[0]), (pair, g_pair, steps[1])):
            step += gradient**2
            value += rate * gradient / np.sqrt(step + 1e-9)
    return Weights(unary, pair)


def text_of(page: Page, content: np.ndarray) -> str:
    """The text of the content nodes, block by block."""
    blocks, now = [], []

    def end() -> None:
        if now:
            line = " ".join("".join(now).split())
            if line:
                blocks.append(line)
            now.clear()

    todo: list = [page.nodes[0]]
    while todo:
        part = todo.pop()
        if part is None:
            end()
        elif isinstance(part, tuple):
            if content[part[0]]:
                now.append(part[1])
        else:
            block = part.tag not in INLINE
            if part.tag == "br":
                now.append(" ")
            elif block:
                end()
                todo.append(None)
            todo += [x if isinstance(x, Node) else (part.number, x) for x in reversed(part.parts)]
    end()
    return " ".join(blocks)


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html in batch["html"]:
                page = featured(parse(html.as_py()))
                texts.append(text_of(page, marginals(page, weights)[0] > 0.5))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def labels_by_mark(nodes: list[Node], mark: str = "keep") -> np.ndarray:
    """1 inside elements whose class names the mark, unless inside one that names "drop" there; else 0."""
    label = np.zeros(len(nodes), np.int64)
    for v in nodes[1:]:
        inside = label[v.parent.number]
        names = v.names.split()
        label[v.number] = 1 if mark in names else 0 if "drop" in names else inside
    return label


def labels_by_article(nodes: list[Node]) -> np.ndarray | None:
    """Labels of a page whose markup says which its article is: one article or main element.

    Headers, footers, menus, asides and forms inside it, and readers' comments, are not
    part of it. None for pages that say nothing or say it more than once.
    """
    tops = [v for v in nodes if v.tag in ("article", "main")]
    outer = [v for v in tops if not any(v is not t and _inside(v, t) for t in tops)]
    if len(outer) != 1:
        return None
    label = np.zeros(len(nodes), np.int64)
    for v in nodes[1:]:
        furniture = v.tag in ("nav", "aside", "footer", "form", "button") or _COMMENTS.search(v.names) or _FURNITURE.search(v.names)
        label[v.number] = 1 if v is outer[0] else 0 if furniture else label[v.parent.number]
    return label


def _inside(node: Node, other: Node) -> bool:
    while node is not None:
        if node is other:
            return True
        node = node.parent
    return False


def labelled_sample(pages: DataFrame, most: int = 100, longest: int = 100_000, id_col: str = "page_id",
                    html_col: str = "html") -> list[tuple[Page, np.ndarray]]:
    """Pages that label themselves, those with the smallest hashes of their ids.

    The sample that weights are fitted on has two bounds, as the driver holds it: ``most``
    pages, and less than ``longest`` characters of HTML in each of them. Pages beyond the
    bounds are only left out of the fit; :func:`extract` judges all pages.
    """
    marked = pages.select(F.col(html_col).cast("string").alias("html"), F.xxhash64(F.col(id_col), F.length(html_col)).alias("h")).filter(
        F.col("html").isNotNull() & (F.length("html") < longest) & (F.col("html").ilike("%<article%") | F.col("html").ilike("%<main%")))
    # The hashes first: pages are sent for those alone that are among the smallest.
    last = marked.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    rows = marked.filter(F.col("h") <= F.lit(last)).orderBy("h", "html").limit(most).collect() if last is not None else []
    out = []
    for row in rows:
        nodes = parse(row.html)
        label = labels_by_article(nodes)
        if label is not None:
            out.append((featured(nodes), label))
    return out

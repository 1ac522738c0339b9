"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks at block-level tags.  Each block has its number of words
and its link density, those of its neighbours, and what its surroundings are called.
A decision tree, trained on the small labelled table in ``html_labels``, keeps or
drops it.  Of the elements around a block, the nearest that is named as main text or as
something beside it decides; names of both kinds at once decide nothing and are a
feature of their own.  Kept blocks are joined in page order.

Defined results: null and empty html, and pages without main text, give an empty
text; unclosed tags are closed by the end of the page; text in script, style and other
elements that are not shown is no block; repeated pages get one result each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountloom.llm import html_labels
from accountloom.llm.frames import map_arrow, row_slices

# FIXED VALUES: element names and the words that class, id and role attributes use
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s "
                   "samp small span strike strong sub sup time tt u var wbr "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts "
                   "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none "
                   "semantics".split())
UNSEEN = ("script", "style", "noscript", "template", "textarea", "select", "svg", "iframe", "object",
          "canvas", "audio", "video", "title", "annotation", "annotation-xml")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form dialog menu button fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments respond reply replies disqus related recommended recommendations sidebar side aside menu nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer foot copyright legal widget "
    "toolbar search form contentinfo complementary dialog teaser tags hidden skip".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = " \t\n\r\x0b\f"
BLANK = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool
    main: bool
    heading: bool
    mixed: bool


def _surroundings(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is not shown, is named as something beside the main text, and as the main text."""
    hidden, aside, main = False, tag in ASIDE_TAGS, tag in MAIN_TAGS
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif name in ("class", "id", "role"):
                named = set(re.findall(r"[a-z]+", value))
                aside |= bool(named & ASIDE_WORDS)
                main |= bool(named & MAIN_WORDS)
    return hidden, aside, main


def split_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with character references decoded."""
    blocks: list[Block] = []
    open_tags: list[tuple[str, bool, bool, bool]] = []  # name, hidden, beside the main text, main text
    # what the open elements with one kind of name are, innermost last: the last one decides
    decided: list[str] = []
    parts: list[str] = []
    linked = 0
    depth = {"a": 0, "hidden": 0, "mixed": 0, "header": 0, "heading": 0}

    def count(tag: str, hidden: bool, aside: bool, main: bool, by: int) -> None:
        depth["hidden"] += by * hidden
        depth["mixed"] += by * (aside and main)
        if aside != main:
            if by > 0:
                decided.append("aside" if aside else "main")
            else:
                decided.pop()
        depth["a"] += by * (tag == "a")
        depth["header"] += by * (tag == "header")
        depth["heading"] += by * (tag in HEADINGS)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = BLANK.sub(" ", "".join(parts)).strip()
            if text:
                heading = depth["heading"] > 0
                # the header of an article holds its headline; any other is beside the main text
                main = decided[-1:] == ["main"] and not depth["hidden"]
                header = depth["header"] > 0 and not (main and heading)
                aside = depth["hidden"] > 0 or decided[-1:] == ["aside"]
                blocks.append(Block(text, text.count(" ") + 1, linked, aside or header, main, heading,
                                    depth["mixed"] > 0))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if depth["a"]:
                linked += len(text.split())

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    for element in reversed(open_tags[k:]):
                        count(*element, -1)
                    del open_tags[k:]
                    break
            continue
        attributes = m[3]
        if tag in UNSEEN:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID or (attributes.rstrip().endswith("/") and tag not in MAIN_TAGS):
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "a") and open_tags and open_tags[-1][0] == tag:
            count(*open_tags.pop(), -1)  # these end where the next one starts
        hidden, aside, main = _surroundings(tag, attributes)
        if tag in ("body", "html"):
            hidden = aside = main = False
        open_tags.append((tag, hidden, aside, main))
        count(tag, hidden, aside, main, 1)
    flush()
    return blocks


def features(blocks: Sequence[Block]) -> np.ndarray:
    """Per block: words and link density of the one before, itself and the next, and its surroundings."""
    words = np.array([0, *(b.words for b in blocks), 0], float)
    linked = np.array([0, *(b.linked for b in blocks), 0], float)
    density = linked / np.maximum(words, 1)
    main = np.array([b.main for b in blocks], float)
    return np.column_stack([
        words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:],
        [b.aside for b in blocks], main, [b.heading for b in blocks],
        np.full(len(blocks), main.any()) > main,  # another block is marked as main text, this one is not
        [b.mixed for b in blocks]])


@dataclass(frozen=True)
class Tree:
    """A binary decision tree; a leaf has feature -1."""

    feature: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    keep: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        while (inner := self.feature[at] >= 0).any():
            f, here = self.feature[at], np.arange(len(rows))
            below = rows[here, np.maximum(f, 0)] <= self.limit[at]
            at = np.where(inner, np.where(below, self.low[at], self.high[at]), at)
        return self.keep[at]


def grow_tree(rows: np.ndarray, keep: np.ndarray, depth: int = 6) -> Tree:
    """Splits with the least Gini impurity, until leaves are pure or ``depth`` is reached."""
    nodes: list[list] = []

    def impurity(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return 2 * p * (1 - p) * len(y)

    def grow(index: np.ndarray, left: int) -> int:
        number = len(nodes)
        y = keep[index]
        nodes.append([-1, 0.0, 0, 0, bool(y.mean() >= 0.5)])
        best = (impurity(y) - 1e-9, None, None)
        if left and impurity(y) > 0:
            for f in range(rows.shape[1]):
                values = np.unique(rows[index, f])
                for limit in (values[:-1] + values[1:]) / 2:
                    below = rows[index, f] <= limit
                    score = impurity(y[below]) + impurity(y[~below])
                    if score < best[0]:
                        best = (score, f, limit)
        if best[1] is not None:
            below = rows[index, best[1]] <= best[2]
            nodes[number][:4] = [best[1], best[2], grow(index[below], left - 1), grow(index[~below], left - 1)]
        return number

    grow(np.arange(len(rows)), depth)
    columns = list(zip(*nodes))
    return Tree(*(np.array(c) for c in columns))


def labelled_table(pages: Sequence[str] = html_labels.PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the marked pages."""
    rows, labels = [], []
    for page in pages:
        blocks = split_blocks(page)
        rows.append(features(blocks))
        labels += [b.text.startswith("+") for b in blocks]
    return np.concatenate(rows), np.array(labels)


def main_text(page: str | None, tree: Tree) -> str:
    blocks = split_blocks(page or "")
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, tree.predict(features(blocks))) if keep)


def _extract(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "html"):
                texts = [main_text(h.as_py(), tree) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, labelled: Sequence[str] = html_labels.PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    tree = grow_tree(*labelled_table(labelled))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_arrow(rows, _extract(tree), "page_id long, url string, text string, n_chars long")

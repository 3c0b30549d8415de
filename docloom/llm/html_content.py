"""Main text of web pages from parser events, by the text-to-tag ratio of their lines.

The standard library's parser gives events, which make a tree of block elements and lines: the text of one block, with the tags and the characters of links it holds, and the element it
lies in. The ratios of characters to tags of the lines outside boilerplate, in page order, are smoothed with a Gaussian; lines above the threshold (the smoothed ratios' standard deviation, at most
their mean) are content clusters. They choose the region:

* With article or main elements, the core is the innermost such level that has half of the clusters' characters in such elements: all of them that lie beside one another there, so no sibling is lost. Of the lines
  around the core, but in an article or main element, those of a cluster belong to it, unless they are mostly links. Lines of the core stay, but for menus: two or more neighbours that are mostly links, whose smoothed
  ratios are on average under half of those of the other lines. A link between paragraphs, or long titles among them, are raised by the smoothing and stay.
* Else it is the innermost element that holds all clusters, and of its lines those from the first to the last cluster, those in an element that has a cluster line itself, and headings right before a
  cluster. Lines that are mostly links and in no cluster are menus.

Boilerplate is never content. An element is boilerplate by its tag, its role, being hidden (``hidden``, ``aria-hidden``, ``display: none``), or a word of its class or id. Reader comments and adverts are so at any size and
wherever they are; an element with another word is a mere wrapper, and no boilerplate, where every line that is left lies in it. Modifiers (``has-sidebar``, ``no-comments``) and states (``comments-closed``) are no marks. Of a header
inside an article or main element the headings stay. Inline boilerplate (a button in a paragraph) is cut out of its line.

Defined results: a null or empty page, or one without text, has an empty text and 0 characters. Unclosed elements end with their parent, a truncated page with its end; an unfinished tag at the end is dropped. White space is what ``str.split`` takes for it. Repeated rows are
extracted row by row; extra columns are passed over. Time grows with the page, not with the depth of its elements.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._frames import column, small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"
SKIPPED = frozenset("script style noscript template svg math head title iframe object canvas nav footer aside form button select option textarea menu dialog audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
#: Ended by the next of its kind.
SINGLE = frozenset("p li td th tr dd dt option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark what is never content, and boilerplate; of an article or main element, only the third count.
NEVER = frozenset("ad ads advert adverts advertisement advertising comment comments discussion disqus promoted replies reply response responses sponsor sponsored".split())
MARKS = NEVER | frozenset("alert alerts banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related share sharing sidebar signup social subscribe toolbar widget".split())
ARTICLE_MARKS = NEVER | frozenset("promo related".split())
#: A name that begins, or ends, with one of these says what the page is like.
MODIFIERS = frozenset("has no non not with without is show hide".split())
STATES = frozenset("enabled disabled open closed on off free".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")


class Line(NamedTuple):
    text: str
    tags: int
    links: int
    node: int
    heading: bool


class Lines(HTMLParser):
    """Collects lines and the tree of block elements: of each its parent, and whether it is boilerplate for sure, marked, or in a header of an article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parent, self.hard, self.marked, self.header = [-1], [False], [False], [False]  # of elements; 0 is the page
        self.level = [0]  # how many article and main elements are around an element, itself included
        self.stack: list[tuple[str, int, int, int]] = []  # tag, and what was before it: node, inline elements to skip, links
        self.open: Counter[str] = Counter()
        self.node = self.skip = self.anchors = 0
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.heading = False

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, max(1, self.tags), self.links, self.node, self.heading))
                self.tags = 0
            self.parts = []
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in SINGLE and self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._pop(i)
                    break
                if self.stack[i][0] in BLOCKS:
                    break
        self.stack.append((tag, self.node, self.skip, self.anchors))
        self.open[tag] += 1
        never, marked = _marks(tag, attrs) if attrs else (False, False)
        hard = tag in SKIPPED or never
        if block:
            inner = self.level[self.node] > 0
            self.parent.append(self.node)
            self.hard.append(hard or tag == "header" and not inner)
            self.marked.append(marked)
            self.level.append(self.level[self.node] + (tag in ARTICLES))
            self.header.append(tag == "header" and inner or self.header[self.node])
            self.node = len(self.parent) - 1
            self.heading = tag in HEADINGS
        elif hard or marked:
            self.skip += 1
        if tag == "a":
            self.anchors += 1

    def _pop(self, i: int) -> None:
        _, node, skip, anchors = self.stack[i]
        for tag, *_ in self.stack[i:]:
            self.open[tag] -= 1
        del self.stack[i:]
        if node != self.node:
            self._end_line()
            self.heading = False
        self.node, self.skip, self.anchors = node, skip, anchors

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        self.parts.append(data)
        if self.anchors:
            self.links += len(data)


def _marks(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether attributes hide an element, or make it no content, for sure; and whether its names mark boilerplate."""
    never = marked = False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            never = True
        elif not value:
            continue
        elif name == "role":
            never |= value.strip().lower() in ROLES
        elif name == "style":
            never |= _HIDDEN.search(value) is not None
        elif name in ("class", "id") and tag not in ("html", "body"):
            names = ARTICLE_MARKS if tag in ARTICLES else MARKS
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                if words and words[0] not in MODIFIERS and words[-1] not in STATES and not names.isdisjoint(words):
                    marked = True
                    never |= not NEVER.isdisjoint(words)
    return never, marked


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """The ratios under a Gaussian of ``sigma`` lines, over three sigmas to each side, weighted anew at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def _sums(parent: list[int], of: list[int], amounts: list[int]) -> list[int]:
    """Amounts by element, those of the elements in it included; a parent has a smaller number than its children."""
    out = [0] * len(parent)
    for node, n in zip(of, amounts, strict=True):
        out[node] += n
    for node in range(len(parent) - 1, 0, -1):
        out[parent[node]] += out[node]
    return out


def _below(parent: list[int], flags: list[bool]) -> list[bool]:
    """Whether an element or one around it has the flag."""
    out = list(flags)
    for node in range(1, len(parent)):
        out[node] = out[node] or out[parent[node]]
    return out


def boilerplate(page: Lines) -> list[bool]:
    """Whether each element is, or lies in, boilerplate: for sure, or by a mark, unless every line that is left lies in the marked element."""
    parent = page.parent
    hard = _below(parent, page.hard)
    if not any(page.marked):
        return hard
    left = [x.node for x in page.lines if not hard[x.node]]
    held = _sums(parent, left, [1] * len(left))
    return _below(parent, [h or m and n < len(left) for h, m, n in zip(page.hard, page.marked, held, strict=True)])


def menus(ratio: np.ndarray, linked: list[bool]) -> list[bool]:
    """Which lines belong to menus: two or more neighbours that are mostly links, with smoothed ratios under half of what lines of text have on average."""
    out = [False] * len(linked)
    if all(linked):
        return out
    least = ratio[~np.array(linked)].mean() / 2
    start = 0
    for i in range(len(linked) + 1):
        if i == len(linked) or not linked[i]:
            if i - start >= 2 and ratio[start:i].mean() < least:
                out[start:i] = [True] * (i - start)
            start = i + 1
    return out


def content(page: Lines) -> list[str]:
    """The texts of the content region."""
    lines, parent = page.lines, page.parent
    if not lines:
        return []
    out_of = boilerplate(page)
    lines = [x for x in lines if not out_of[x.node] and (x.heading or not page.header[x.node])]
    if not lines:
        return []
    ratio = smoothed(np.array([len(x.text) / x.tags for x in lines]))
    cluster = (ratio >= min(ratio.std(), ratio.mean())).tolist()
    amounts = [len(x.text) if c else 0 for x, c in zip(lines, cluster, strict=True)]
    total = sum(amounts)
    nodes = [x.node for x in lines]
    heavy = _sums(parent, nodes, amounts)
    level, held = page.level, Counter()
    for node in range(1, len(parent)):
        if level[node] > level[parent[node]]:
            held[level[node]] += heavy[node]
    chosen = max((k for k, n in held.items() if 2 * n >= total), default=0)
    if chosen:
        linked = [2 * x.links >= len(x.text) for x in lines]
        core = [(level[x.node] >= chosen or level[x.node] > 0 and c and not of_links) for x, c, of_links in zip(lines, cluster, linked, strict=True)]
        at = np.flatnonzero(core)
        in_menu = menus(ratio[at], [linked[i] for i in at])
        return [lines[i].text for i, m in zip(at, in_menu, strict=True) if not m]
    region = max(node for node in range(len(parent)) if heavy[node] == total)
    inside = [False] * len(parent)
    inside[region] = True
    for node in range(region + 1, len(parent)):
        inside[node] = inside[parent[node]]
    own = {x.node for x, c in zip(lines, cluster, strict=True) if c}
    at = [i for i, c in enumerate(cluster) if c]
    first, last = at[0], at[-1]
    while first and lines[first - 1].heading:
        first -= 1
    kept = []
    for i, x in enumerate(lines):
        if (cluster[i] or 2 * x.links < len(x.text)) and (first <= i <= last or inside[x.node] and (x.node in own or parent[x.node] in own)):
            kept.append(x.text)
    return kept


def main_text(html: str | None) -> str:
    html = html or ""
    upto = html.rfind(">") + 1  # after it no tag is finished
    tail = _UNFINISHED.search(html, upto)
    page = Lines()
    page.feed(html[: tail.start()] if tail else html)
    page.close()
    page._end_line()
    return "\n".join(content(page))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    part = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), column(pages, html_col).cast("string").alias("html"))
    return part.mapInArrow(run, SCHEMA)

"""HTML extraction by text-to-tag ratios.

The standard library's parser sends events as it reads. Block-level tags end a line (a block of
text); for each line its characters, its tags, its characters in links, and its container are kept, and the
containers form a tree. The text-to-tag ratio of a line, its characters over its tags, is smoothed by a
Gaussian over the neighbouring lines, and a threshold between two clusters of the smoothed ratios
(one-dimensional two-means on their logarithms) selects the content lines, those whose own ratio passes it too. What is selected decides
on the region: the innermost section-like container that holds every selected line. An ``article`` (or else ``main``) around
it widens it, and so do headings right before it; if only the body holds all selected lines, the region is
what lies between the first and the last of its parts that hold some. The lines of the region, short
headings included, are the text.

Page furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) and what is not shown (scripts,
styles, ...) never counts and never is part of it. Furniture is known by its tag, role, or a whole class name or id. A class name
that only has such a word as a part (``sidebar-right``, ``comments-open``) marks furniture if the container
holds less than half of the page's text, and so does a ``form``: what wraps the page is not furniture.

Everything takes time and memory in proportion to the page, however deep it is nested.

Defined results: null or empty html gives empty text; a page without content lines gives empty text;
rows that repeat are repeated; null page_id or url are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

SIGMA = 1.0  # lines
APART = 0.7  # of the clusters' logarithms, at least
WRAPS = 0.5  # of the page's text: a container with more of it is no furniture for a part of its class name

#: HTML's element names, by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav noscript ol option p pre search section summary table tbody td tfoot th thead tr ul caption title head select textarea button".split()
)
HIDDEN = set("script style template head title noscript iframe object svg canvas select option textarea button".split())
FURNITURE = set("nav header footer aside menu dialog".split())
SECTIONS = set("div section article main center".split())  # what a region may be
BODY = set("html body".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids of page furniture.
NAMES = set(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars aside"
    " footer masthead header cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe signup login share sharing social"
    " comment comments disqus reply replies respond related recommended recommendations widget toolbar pagination pager skip alert".split()
)
#: Parts that make a class name say what the page has, not what the container is.
ABOUT = set("has have with without no non is not show shows hide hides".split())
_PART = re.compile(r"[a-z]+")


class _Line:
    __slots__ = ("linked", "of", "tags", "text")

    def __init__(self, of: int) -> None:
        self.of = of  # number of the container
        self.text: list[str] = []
        self.tags = self.linked = 0


NOT, PERHAPS, SURELY, UNSEEN = range(4)  # whether a container is furniture


class Lines(HTMLParser):
    """Collects the lines of a page and its containers: tag, parent (-1: none) and furniture of each, by number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.furniture: list[int] = []
        self.stack: list[tuple[str, int]] = []  # open block-level elements: tag, number
        self.open: dict[str, int] = {}  # how many of each tag are open
        self.links = 0
        self.line = _Line(-1)

    def _end_line(self) -> None:
        if self.line.text or self.line.tags:
            self.lines.append(self.line)
        self.line = _Line(self.stack[-1][1] if self.stack else -1)

    def _pop_to(self, depth: int) -> None:
        for tag, _ in self.stack[depth:]:
            self.open[tag] -= 1
        del self.stack[depth:]
        self._end_line()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in BLOCK and tag not in HIDDEN:
            self.line.tags += 1
            self.links += tag == "a"
            if tag == "br":
                self.line.text.append(" ")
            return
        if tag in CLOSES_P and self.open.get("p"):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] == "p":
                    self._pop_to(depth)
                    break
                if self.stack[depth][0] in ("td", "th", "button", "article", "section", "div", "body", "li", "blockquote"):
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            peers = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            for depth in range(len(self.stack) - 1, -1, -1) if any(self.open.get(x) for x in peers) else ():
                if self.stack[depth][0] in peers:
                    self._pop_to(depth)
                    if tag != "tr" or self.stack and self.stack[-1][0] not in peers:
                        break
                elif self.stack[depth][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag == "body" and self.open.get("head"):  # a page without an end of its head
            for depth, x in enumerate(self.stack):
                if x[0] == "head":
                    self._pop_to(depth)
                    break
        if tag in VOID:
            self._end_line()
            return
        self.kinds.append(tag)
        self.parents.append(self.stack[-1][1] if self.stack else -1)
        self.furniture.append(self._furniture(tag, attrs))
        self.stack.append((tag, len(self.kinds) - 1))
        self.open[tag] = self.open.get(tag, 0) + 1
        self._end_line()
        self.line.tags += 1

    @staticmethod
    def _furniture(tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in HIDDEN:
            return UNSEEN
        if tag in FURNITURE:
            return SURELY
        if tag in BODY or tag == "main":
            return NOT
        found = PERHAPS if tag == "form" else NOT
        for name, value in attrs:
            if name in ("class", "id") and value:
                for word in value.lower().split():
                    if word in NAMES:
                        return SURELY
                    parts = set(_PART.findall(word))
                    if NAMES & parts and not ABOUT & parts:
                        found = PERHAPS
            elif name == "role" and value and value.lower().strip() in ROLES:
                return SURELY
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return UNSEEN
        return found

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in BLOCK and tag not in HIDDEN:
            self.links -= tag == "a" and self.links > 0
            return
        for depth in range(len(self.stack) - 1, -1, -1) if self.open.get(tag) else ():
            if self.stack[depth][0] == tag:
                self._pop_to(depth)
                return
        self._end_line()

    def handle_data(self, data: str) -> None:
        self.line.text.append(data)
        if self.links:
            self.line.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel ends at three sigma and is normalised at the edges."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - reach), min(len(values), i + reach + 1))
        out.append(sum(kernel[abs(i - j)] * values[j] for j in near) / sum(kernel[abs(i - j)] for j in near))
    return out


def threshold(logs: list[float]) -> float:
    """The middle between two clusters; if they aren't apart all values are one cluster, and the least is given."""
    low, high = min(logs), max(logs)
    for _ in range(30):
        middle = (low + high) / 2
        under, over = [x for x in logs if x <= middle], [x for x in logs if x > middle]
        if not under or not over:
            break
        new = sum(under) / len(under), sum(over) / len(over)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low >= APART else min(logs)


def _sums(values: list[int], parents: list[int]) -> list[int]:
    """Each container's value with those of all in it; a container has a greater number than its parent."""
    out = list(values)
    for c in range(len(out) - 1, -1, -1):
        if parents[c] >= 0:
            out[parents[c]] += out[c]
    return out


def _inherited(own: list, parents: list[int], none=None) -> list:
    """Each container's value, or that of the nearest container around it that has one."""
    out: list = []
    for value, parent in zip(own, parents, strict=True):
        out.append(value if value is not none or parent < 0 else out[parent])
    return out


def _not_content(page: Lines, chars: list[int]) -> list[bool]:
    """Whether each container is furniture or lies in some, or is not shown. ``chars``: of its own lines."""
    shown = _inherited([f == UNSEEN or None for f in page.furniture], page.parents)
    seen = [0 if hidden else n for n, hidden in zip(chars, shown, strict=True)]
    sure = _inherited([f == SURELY or None for f in page.furniture], page.parents)
    text = [0 if s else n for n, s in zip(seen, sure, strict=True)]
    within, whole = _sums(text, page.parents), sum(text)
    own = [f > PERHAPS or f == PERHAPS and n <= WRAPS * whole or None for f, n in zip(page.furniture, within, strict=True)]
    return [bool(x) for x in _inherited(own, page.parents)]


def select(lines: list[tuple[int, int, int]]) -> list[bool]:
    """Which lines (characters, characters in links, tags) are content: their smoothed ratios are above the threshold, and
    so are their own, unless none is, as smoothing reaches over the ends of the content."""
    ratios = [max(0, chars - linked) / (1 + tags) for chars, linked, tags in lines]
    logs = [math.log1p(r) for r in smooth(ratios)]
    least = threshold(logs)
    near = [x >= least for x in logs]
    both = [yes and math.log1p(r) >= least for yes, r in zip(near, ratios, strict=True)]
    return both if any(both) else near


def extract(html: str | None) -> tuple[str, int]:
    """Main text of a page, and its number of blocks."""
    if not html:
        return "", 0
    page = Lines()
    page.feed(html)
    page.close()
    # one more container around all, so that every line has one
    kinds, parents = ["html", *page.kinds], [-1, *[p + 1 for p in page.parents]]
    page.kinds, page.parents, page.furniture = kinds, parents, [NOT, *page.furniture]
    rows = [(line, line.of + 1, " ".join("".join(line.text).split())) for line in page.lines]
    chars = [0] * len(kinds)
    for _, of, text in rows:
        chars[of] += len(text)
    out = _not_content(page, chars)
    rows = [(line, of, text) for line, of, text in rows if text and not out[of]]
    if not rows:
        return "", 0
    chosen = select([(len(text), line.linked, line.tags) for line, _, text in rows])
    picked = [i for i, yes in enumerate(chosen) if yes]
    own = [0] * len(kinds)
    for i in picked:
        own[rows[i][1]] += 1
    holds = _sums(own, parents)
    around = _inherited([c if k in SECTIONS else None for c, k in enumerate(kinds)], parents)  # the nearest section
    region = max((c for c in range(len(kinds)) if holds[c] == len(picked) and kinds[c] in SECTIONS), default=None)
    if region is not None:
        at, wide = region, {}
        while at is not None:
            wide.setdefault(kinds[at], at)
            at = around[parents[at]] if parents[at] >= 0 else None
        region = wide.get("article", wide.get("main", region))
        within = _inherited([True if c == region else None for c in range(len(kinds))], parents)
        at = [i for i, (_, of, _) in enumerate(rows) if within[of]]
    else:
        # the parts of the body that hold selected lines, and all between the first and the last of them
        within = None
        part = _first([c if k in SECTIONS else None for c, k in enumerate(kinds)], parents)
        parts = {part[rows[i][1]] for i in picked}
        at = [i for i, (_, of, _) in enumerate(rows) if part[of] in parts]
    first, last = at[0], at[-1]
    heading = _inherited([True if k in ("h1", "h2") else None for k in kinds], parents)
    while first > 0 and heading[rows[first - 1][1]]:
        first -= 1
    if within is not None:
        kept = [text for i, (_, of, text) in enumerate(rows) if within[of] or first <= i < at[0]]
    else:
        kept = [text for _, _, text in rows[first : last + 1]]
    return "\n\n".join(kept), len(kept)


def _first(own: list, parents: list[int]) -> list:
    """Each container's outermost value: that of the first container around it, or itself, that has one."""
    out: list = []
    for value, parent in zip(own, parents, strict=True):
        out.append(out[parent] if parent >= 0 and out[parent] is not None else value)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks for every row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [extract(h) for h in batch["html"]]
            texts = [t for t, _ in got]
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts], n_blocks=[n for _, n in got])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long, n_blocks int")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks."""
    return extract_pages(table(spark, sf_dir, "pages"))

"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams over a page. Every block of text is a *line* with the number of
tags in it; its ratio is characters by tags, and 0 inside menus, adverts, forms and the like. Ratios are
smoothed with a Gaussian, and lines at or above a threshold (their standard deviation, as far as any
line reaches it) form the content clusters. A cluster stands for the element it lies in - its article or
main element, else its nearest division - and all lines of that element are content, short ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tailseries.llm.common import ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
_DROPPED = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video nav header footer aside "
    "form button select option textarea fieldset dialog menu".split()
)
#: Ends that pages leave out: a new article ends these.
_ENDED_BY_ARTICLE = frozenset("head nav header footer aside form".split())
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside "
    "menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice "
    "alert popup modal overlay comment comments disqus respond replies newsletter subscribe signup login search "
    "share sharing social related recommended recommendations widget pagination pager copyright skip toolbar".split()
)
#: Parts of a class name that say nothing by themselves.
_NEUTRAL = frozenset(
    "site page main top bottom left right inner outer box block bar area wrapper wrap container section list item "
    "items panel row col column group links link text icon icons buttons button form global primary secondary fixed".split()
)
#: Only elements that hold others are judged by their class names, and none inside the main element that holds text.
_CONTAINERS = frozenset("div section ul ol dl table tbody tr td span a p figure center".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody figcaption span a".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_MAIN = frozenset(("article", "main"))
_SECTION = frozenset("body div section td center dd blockquote details".split())


def _names_furniture(value: str) -> bool:
    """Whether one of the names in a class or id consists of hints, and perhaps neutral parts, only."""
    for name in value.lower().split():
        parts = [p for p in name.replace("_", "-").split("-") if p]
        if any(p in _HINTS for p in parts) and all(p in _HINTS or p in _NEUTRAL or p.isdigit() for p in parts):
            return True
    return False


def _unwanted(tag: str, attrs: list, inside: bool) -> bool:
    """Whether an element is no content by its tag, role, state or, of containers, its names."""
    if tag in _DROPPED:
        return True
    for name, value in attrs:
        if name in ("class", "id"):
            if value and tag in _CONTAINERS and not (inside and tag in _TEXT) and _names_furniture(value):
                return True
        elif name == "role":
            if value and value.strip().lower() in _ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class _Lines(HTMLParser):
    """Collects (text, tags, dropped, element) of every block, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int]] = []
        self.stack: list[tuple[str, bool, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.elements = 0
        #: How many open elements are main ones, and how many a new article ends.
        self.main = self.ended = 0
        #: Places in the stack of the open elements of each name.
        self.open: dict[str, list[int]] = {}

    def _push(self, tag: str, dropped: bool, element: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, dropped, element))
        self.main += tag in _MAIN
        self.ended += tag in _ENDED_BY_ARTICLE

    def _pop(self) -> None:
        tag = self.stack.pop()[0]
        self.open[tag].pop()
        self.main -= tag in _MAIN
        self.ended -= tag in _ENDED_BY_ARTICLE

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            self._pop()

    def _state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            dropped, element = self._state()
            self.lines.append((text, self.tags, dropped, element))
        self.parts, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag == "hr":
            self.parts.append(" ")
            self.tags += 1
            return
        if tag in _VOID:
            self.tags += 1
            return
        if tag in _INLINE:
            self.tags += 1
            if not attrs and not (self.stack and self.stack[-1][1]):
                return
            dropped, element = self._state()
            if dropped or _unwanted(tag, attrs, self.main > 0):
                if not dropped:
                    self.end_line()
                self._push(tag, True, element)
            return
        self.end_line()
        self.tags = 1
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
            self._pop_open(tag)
        elif tag in _MAIN or tag == "body":
            while self.stack and self.ended:
                self._pop()
        dropped, element = self._state()
        inside = self.main > 0
        if tag == "header" and inside and not dropped:
            pass
        elif not dropped:
            dropped = _unwanted(tag, attrs, inside)
        if tag in _MAIN and not inside or tag in _SECTION and not inside:
            self.elements += 1
            element = self.elements
        self._push(tag, dropped, element)

    def _pop_open(self, tag: str) -> None:
        """A p ends an open p, a li an open li, unless a container lies between."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                self._cut(i)
                return
            if name not in _INLINE and name not in ("p", "dt", "dd", "td", "th"):
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _INLINE:
            if self.stack and self.stack[-1][0] == tag:
                if self.stack[-1][1] and not (len(self.stack) > 1 and self.stack[-2][1]):
                    self.end_line()
                self._pop()
            return
        if tag == "br":
            self.parts.append(" ")
            return
        self.end_line()
        at = self.open.get(tag)
        if not at:
            return
        if tag not in _MAIN and tag not in ("body", "html"):
            # No end tag from inside a main element ends one outside of it.
            mains = [self.open[m][-1] for m in _MAIN if self.open.get(m)]
            if mains and max(mains) > at[-1]:
                return
        self._cut(at[-1])

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean over the neighbouring lines."""
    radius = max(1, int(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius), kernel / kernel.sum(), "valid")


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    ratios = np.array([0.0 if dropped else len(text) / max(1, tags) for text, tags, dropped, _ in lines])
    if not ratios.any():
        return ""
    smoothed = smooth(ratios)
    wanted = smoothed >= min(float(smoothed.std()), float(smoothed[ratios > 0].max()))
    elements = {line[3] for line, hit in zip(lines, wanted) if hit and not line[2]}
    return " ".join(text for text, _, dropped, element in lines if not dropped and element in elements)


def _extract(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts = [main_text(html) for html in batch.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["_id", "_url", "text"]
        )


def extract_main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """The main text of every page: id, url, text and n_chars (code points).

    One row per input row. Null, empty and text-free pages have text ''. Pages are independent of each
    other, so repeated rows, null ids and ties need no rule; other columns are not read. Pages are
    read whole, whatever their length, and left as they are when tags are not closed.
    """
    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return (
        pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
        .mapInArrow(_extract, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string")
        .select(
            F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
        )
    )

"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, clustering.

The standard-library parser streams through the whole page. A line is the text of one block element;
its ratio is the number of text characters over the number of tags met (plus one), and 0 where an
enclosing element or attribute marks furniture (menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments). Ratios are smoothed with a Gaussian; lines above the
threshold (one standard deviation of the page's smoothed ratios, at most half their maximum) form the
content clusters. A line of a cluster whose own ratio is above the threshold too selects the region it lies
in (its ``article`` or ``main`` element, else the element that holds the block); every line of the region that
is not furniture is kept, so short headings and paragraphs stay, and so are headings of a cluster outside of
its region. Beside selected articles another region stands if it has as much content as the largest of them.
Attributes and forms are only evidence of furniture: on a page without an unmarked article they do not count
for an element that holds more than half of the page's text. A name that merely begins or ends with a furniture word
(``kwil-comments``) counts inside an article only for less than half of the article's text.

Edge cases. Null, empty and text-free pages give an empty text. Unclosed and stray tags are tolerated;
a construct on which the parser gives up is text. Repeated rows and null ids are kept, extra
columns are ignored. Memory is bounded by one Arrow batch and one page's lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and attribute words by their role on a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form script style noscript template iframe svg button select textarea object canvas dialog menu head title label".split())
MARKED = frozenset(
    "alert disclaimer paywall ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted adsbygoogle doubleclick outbrain taboola recommended related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Words that may stand beside them in one name ("sidebar-left", "reader-comments"): such a name marks furniture for sure.
BESIDE = frozenset(
    "area bar block bottom box button buttons col column container default feed first fixed global group horizontal inner item items large last left link links list main mobile module outer page panel post posts primary reader readers right row secondary section side site slot small sticky thread threads top unit user users vertical view widgets wrap wrapper".split()
)
# Words with which a name is about furniture that is not there, or about its state ("has-sidebar", "ad-free", "comment-status-open").
ABOUT = frozenset("can closed count disabled enabled free has is no non not number off on open show status total with without".split())
PAGE_TOP = frozenset("header masthead topbar".split())  # furniture outside of an article
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
SOFT = frozenset(["form"])  # may be wrapped around a whole page
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = BLOCKS - HEADINGS - frozenset("address caption dd dt figcaption li p pre summary".split())
SIGMA = 1.0
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")
SURE, MAYBE = 2, 1


def _named(value: str, words: frozenset[str]) -> int:
    """What the names in an attribute tell of ``words``: ``SURE``, ``MAYBE`` or 0. Names are cut at hyphens, digits and capitals.

    A name of ``words`` and of words that may stand beside them is sure. One that only begins or ends with such a word may name
    furniture, unless it says that there is none.
    """
    found = 0
    for name in value.split():
        parts = [x.lower() for x in _WORD.findall(name)]
        if not words.intersection(parts):
            continue
        if set(parts) <= words | MARKED | BESIDE:
            return SURE
        if (parts[0] in words or parts[-1] in words) and not ABOUT.intersection(parts):
            found = MAYBE
    return found


class Place(NamedTuple):
    """Where text stands: in hard furniture, in elements marked as furniture, in a region, in which holding element."""

    hard: bool = False
    marks: tuple[int, ...] = ()
    region: int = 0
    holder: int = 0
    heading: bool = False


class _Lines(HTMLParser):
    """Collects ``(text, tags, place)`` for each block of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, Place]] = []
        self.lines: list[tuple[str, int, Place]] = []
        self.text: list[str] = []
        self.tags = 0
        self.serial = 0
        self.place = Place()
        self.doubtful: dict[int, int] = {}  # marks inside an article that count only for less than half of its text: the article

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except (AssertionError, ValueError):
            self.handle_data(self.rawdata[i : i + 2])
            return i + 2

    def close_line(self) -> None:
        words = _SPACE.sub(" ", "".join(self.text)).strip()
        if words:
            self.lines.append((words, self.tags, self.place))
            self.tags = 0
        self.text = []

    def _top(self) -> Place:
        return self.stack[-1][1] if self.stack else Place()

    def _is_hard(self, tag: str, attrs: list[tuple[str, str | None]], region: int) -> bool:
        """Furniture by the element itself, or not shown at all."""
        if tag in FURNITURE - SOFT or (tag == "header" and not region):
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            value = (value or "").lower()
            if name == "style" and "display:none" in value.replace(" ", "") or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    def _marked(self, tag: str, attrs: list[tuple[str, str | None]], region: int) -> int:
        if tag in SOFT:
            return SURE
        if tag in ("html", "body", "main"):
            return 0
        found = 0
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                found = max(found, _named(value, MARKED), 0 if region else _named(value, PAGE_TOP) // SURE * SURE)
            if name == "aria-label":
                found = max(found, _named("-".join(value.split()), MARKED) // SURE * SURE)
            if name == "role" and value.strip().lower() in ROLES:
                found = SURE
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.close_line()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "p":  # a paragraph ends the one before
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    del self.stack[k:]
                    break
                if self.stack[k][0] in BLOCKS:
                    break
        hard, marks, region, holder, heading = self._top()
        hard = hard or self._is_hard(tag, attrs, region)
        self.serial += 1
        mark = self._marked(tag, attrs, region) if not hard else 0
        if mark == MAYBE and region:
            self.doubtful[self.serial] = region
            marks += (self.serial,)
        elif mark:
            marks += (-self.serial if region else self.serial,)  # negative: inside an article, where a sure mark always counts
        if tag in ("article", "main") and not hard:
            region = self.serial
        if tag in HOLDERS:
            holder = self.serial
        self.stack.append((tag, Place(hard, marks, region, holder, tag in HEADINGS or heading and tag not in BLOCKS)))
        self._settle()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.close_line()
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
        self._settle()

    def _settle(self) -> None:
        """Text of another standing than the open line's starts a line of its own."""
        now = self._top()
        if now != self.place:
            self.close_line()
            self.place = now

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the kernel renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by a newline; empty if there is none."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.close_line()
    lines = parser.lines
    held: dict[int, int] = {}  # characters in elements marked as furniture
    within: dict[int, int] = {}  # and in articles
    for text, _, place in lines:
        for mark in place.marks if not place.hard else ():
            held[mark] = held.get(mark, 0) + len(text)
        if not place.hard:
            within[place.region] = within.get(place.region, 0) + len(text)
    total = sum(len(text) for text, _, place in lines if not place.hard)
    sure = any(place.region and not place.hard and not place.marks for _, _, place in lines)

    def counts(mark: int) -> bool:
        if mark in parser.doubtful:
            return 2 * held[mark] < within.get(parser.doubtful[mark], 0)
        return sure or mark < 0 or 2 * held[mark] <= total

    furniture = np.array([place.hard or any(map(counts, place.marks)) for _, _, place in lines], bool)
    if furniture.all():
        return ""
    ratios = np.array([0.0 if bad else len(text) / (tags + 1) for (text, tags, _), bad in zip(lines, furniture, strict=True)])
    level = smoothed(ratios)
    least = min(float(level.std()), float(level[~furniture].max()) / 2)
    cluster = (level >= least) & ~furniture
    chosen = cluster & (ratios >= least) if (cluster & (ratios >= least)).any() else cluster
    content: dict[tuple[bool, int], int] = {}  # characters by region
    for k in np.flatnonzero(chosen):
        place = _region(lines[k][2])
        content[place] = content.get(place, 0) + len(lines[k][0])
    article = max((n for (inside, _), n in content.items() if inside), default=0)
    kept = {place for place, n in content.items() if place[0] or n >= article}
    loose = not article  # an article has its headings inside
    return "\n".join(text for k, (text, _, place) in enumerate(lines) if not furniture[k] and (_region(place) in kept or loose and cluster[k] and place.heading))


def _region(place: Place) -> tuple[bool, int]:
    """The article or main element, else the holding element."""
    return (True, place.region) if place.region else (False, place.holder)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (``page_id, url, html``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(scan, f"page_id {kind}, url string, text string, n_chars long")

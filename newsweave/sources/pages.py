"""Pages to article text: a streaming parser that knows nesting and all character references; access walls leave a title only."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.functions import text as T

DENIED = r"(?i)access denied|403 forbidden|just a moment"
UNSEEN = frozenset({"script", "style", "noscript", "template"})
_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")
SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\f\r\xa0", " "))


class _Page(HTMLParser):
    """Texts of a page by where they stand: title, first article with all that is nested in it, body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.article: list[str] = []
        self.body: list[str] = []
        self.in_title = self.in_head = self.article_done = False
        self.articles = self.unseen = 0

    def _text(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.unseen:
            if self.articles:
                self.article.append(data)
            if not self.in_head:
                self.body.append(data)

    def handle_data(self, data: str) -> None:
        self._text(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._text(" ")
        if tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "title" and not self.title and not self.articles:
            self.in_title = True
        elif tag in UNSEEN:
            self.unseen += 1
        elif tag == "article" and not self.article_done and not self.unseen:
            self.articles += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._text(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
        elif tag == "title":
            self.in_title = False
        elif tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag == "article" and self.articles:
            self.articles -= 1
            self.article_done = not self.articles
        self._text(" ")


def _joined(parts: list[str]) -> str:
    return " ".join(x for x in "".join(parts).translate(SPACES).split(" ") if x)


def _ended(found: re.Match) -> str:
    return found[0] if found[1] in html5 else "&amp;" + (found[1] or "")


def page_parts(html: str | None, bare: bool = True) -> tuple[str, str]:
    """Title and body of a page, white space run together; the body is the first article, nested ones included, else all of the body.

    ``bare``: whether references count that no semicolon ends, as browsers read them (``&amp`` at the end of a title that was cut).
    """
    page = _Page()
    page.feed((html or "") if bare else _REFERENCE.sub(_ended, html or ""))
    page.close()
    return _joined(page.title), _joined(page.article) or _joined(page.body)


def _parsed(batches: Iterator[pa.RecordBatch], bare: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [page_parts(x, bare) for x in batch.column(2).to_pylist()]
        texts = [pa.array([p[k] for p in parts], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *texts], ["page_id", "url", "title", "body"])


def page_articles(pages: DataFrame, bare: bool = True) -> DataFrame:
    """``page_id, url, title, text, status, title_domain_hash``: the article's text as title and body.

    ``bare`` as for ``page_parts``. ``status`` is ``denied`` for access walls, ``failed`` without text (also for null pages), else ``ok``; only an ok page has a text.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html").mapInArrow(functools.partial(_parsed, bare=bare), f"page_id {kind}, url string, title string, body string")
    status = F.when(F.col("title").rlike(DENIED), "denied").when(F.col("body") == "", "failed").otherwise("ok")
    text = F.concat(F.lit("Title: "), "title", F.lit("\nBody: "), "body", F.lit("\n"))
    rows = rows.withColumn("status", status)
    return rows.select("page_id", "url", "title", F.when(F.col("status") == "ok", text).otherwise("").alias("text"), "status", T.title_domain_hash(F.col("url"), F.col("title")).alias("title_domain_hash"))


def denied_records(parsed: DataFrame) -> DataFrame:
    """Records of pages behind an access wall (rows of ``page_articles``): not relevant, known by their title and domain only."""
    empty = F.lit(None).cast("string")
    return parsed.where("status = 'denied'").select("page_id", "url", "title_domain_hash", empty.alias("hash"), F.lit(False).alias("is_relevant"))

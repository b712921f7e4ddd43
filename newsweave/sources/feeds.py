"""Feed payloads to entries: decoding, XML and JSON feeds, diagnostics."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions import text as T

JSON_FEED = "items ARRAY<STRUCT<id: STRING, url: STRING, title: STRING, date_published: STRING>>"
XML_FEED = (
    "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, pubDate: STRING>>>, "
    "entry ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING>>, published: STRING, updated: STRING>>"
)
# Character references that feeds use and XML does not know (or not everywhere), by number.
REFERENCES = (
    ("nbsp", 160), ("copy", 169), ("reg", 174), ("trade", 8482), ("mdash", 8212), ("ndash", 8211), ("hellip", 8230),
    ("lsquo", 8216), ("rsquo", 8217), ("ldquo", 8220), ("rdquo", 8221), ("apos", 39),
)
_CHARSET = re.compile(r"charset=[\"']?([\w-]+)", re.I)


def _unpacked(body: bytes, encoding: str | None) -> tuple[bytes, str]:
    if (encoding or "").strip().lower() == "br":
        return b"", "unsupported_encoding"
    for window in (31, 15, -15):
        unpacker = zlib.decompressobj(window)
        try:
            out = unpacker.decompress(body) + unpacker.flush()
        except zlib.error:
            continue
        if unpacker.eof and out:
            return out, "ok"
    return body, "ok"


def _decoded(body: bytes, content_type: str | None) -> str | None:
    named = _CHARSET.search(content_type or "")
    for charset in ("utf-8", *([named[1]] if named else []), "windows-1252", "shift_jis"):
        try:
            return body.decode(charset)
        except (UnicodeDecodeError, LookupError):
            continue
    return None


def decoded_payloads(payloads: DataFrame) -> DataFrame:
    """``feed_url, content_type, text, status`` of raw payloads: gzip, zlib, deflate or plain; UTF-8 first.

    Bodies that are plain UTF-8 text are decoded by a built-in; only the others pass through Python.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, kind, encoding, body in zip(frame["feed_url"], frame["content_type"], frame["content_encoding"], frame["body"], strict=True):
                raw, status = _unpacked(bytes(body), encoding) if body is not None else (b"", "empty")
                text = _decoded(raw, kind) if status == "ok" else None
                rows.append((url, kind, text, status if text is not None or status != "ok" else "undecodable"))
            yield pd.DataFrame(rows, columns=["feed_url", "content_type", "text", "status"])

    # A text never begins with the first byte of gzip or zlib data, and raw deflate data of a text is no UTF-8 text with markup.
    head = F.ltrim(F.substring(F.col("body").cast("string"), 1, 64))
    plain = F.coalesce(F.is_valid_utf8(F.col("body").cast("string")) & head.rlike(r"^[\uFEFF]?\s*[<{\[]") & (F.coalesce(F.lower(F.trim("content_encoding")), F.lit("")) != "br"), F.lit(False))
    easy = payloads.where(plain).select("feed_url", "content_type", F.col("body").cast("string").alias("text"), F.lit("ok").alias("status"))
    hard = payloads.where(~plain).select("feed_url", "content_type", "content_encoding", "body").mapInPandas(decode, "feed_url string, content_type string, text string, status string")
    return easy.unionByName(hard)


def cleaned_xml(body: Column) -> Column:
    """Cut to the first declaration or root, named entities as numbers, characters that XML forbids removed."""
    body = F.regexp_replace(body, r"^﻿", "")
    body = F.regexp_replace(body, r"(?s)^.*?(?=<\?xml|<rss|<feed)", "")
    for name, number in REFERENCES:
        body = F.replace(body, F.lit(f"&{name};"), F.lit(f"&#{number};"))
    body = F.replace(body, F.lit("&amp;amp;"), F.lit("&amp;"))
    body = F.regexp_replace(body, r"[^\x09\x0A\x0D\x20-퟿-�\x{10000}-\x{10FFFF}]", "")
    return F.when(body.startswith("<?xml"), body).otherwise(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), body))


def json_entries(payloads: DataFrame, numbered: bool = False) -> DataFrame:
    """``feed_url, url, title, published`` of JSON feeds; entries without url and id go, dates that cannot be read stay raw.

    ``numbered`` adds the ``position`` of an entry in its feed, from 0: entries may share a URL.
    """
    items = payloads.select("feed_url", F.posexplode(F.from_json("text", JSON_FEED)["items"]).alias("position", "i"))
    url = F.coalesce("i.url", "i.id")
    when = F.coalesce(F.date_format(T.feed_time(F.col("i.date_published")), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.col("i.date_published"))
    return items.where(url.isNotNull()).select("feed_url", *["position"] * numbered, url.alias("url"), F.col("i.title").alias("title"), when.alias("published"))


def xml_entries(payloads: DataFrame) -> DataFrame:
    """``feed_url, url, title, published`` of RSS and Atom feeds; a second, cleaned attempt where the first finds nothing."""
    spark_xml = lambda c: F.from_xml(c, XML_FEED, {"mode": "PERMISSIVE"})
    first = payloads.withColumn("x", spark_xml(F.col("text")))
    empty = F.coalesce(F.size("x.channel.item"), F.lit(0)).between(-1, 0) & F.coalesce(F.size("x.entry"), F.lit(0)).between(-1, 0)
    again = first.withColumn("clean", cleaned_xml(F.col("text"))).withColumn("x", F.when(empty, spark_xml(F.col("clean"))).otherwise(F.col("x")))
    rss = again.select("feed_url", F.explode("x.channel.item").alias("i")).select("feed_url", F.trim("i.link").alias("url"), F.col("i.title").alias("title"), F.col("i.pubDate").alias("published"))
    atom = again.select("feed_url", F.explode("x.entry").alias("e")).select("feed_url", F.get(F.col("e.link"), F.lit(0))["_href"].alias("url"), F.col("e.title").alias("title"), F.coalesce("e.published", "e.updated").alias("published"))
    both = rss.unionByName(atom).where("url IS NOT NULL AND url <> ''")
    return both.withColumn("published", F.coalesce(F.date_format(T.feed_time(F.col("published")), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.col("published")))


def feed_diagnostics(payloads: DataFrame, entries: DataFrame) -> DataFrame:
    """Per feed its status, entries and warnings."""
    counted = entries.groupBy("feed_url").agg(F.count("*").alias("entries"), F.count_if(F.col("published").isNull()).alias("undated"), F.count_if(F.coalesce(F.col("title"), F.lit("")) == "").alias("untitled"))
    rows = payloads.join(counted, "feed_url", "left").na.fill(0, ["entries", "undated", "untitled"])
    warn = F.array_compact(F.array(F.when(F.col("undated") > 0, "entries without a date"), F.when(F.col("untitled") > 0, "entries without a title"), F.when(~T.valid_feed_url(F.col("feed_url")), "feed URL is not http or https")))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("entries") == 0, "no_entries").otherwise("ok")
    return rows.select("feed_url", status.alias("status"), "entries", F.array_join(warn, "; ").alias("warnings"))

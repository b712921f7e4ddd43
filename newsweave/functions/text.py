"""Scalar column functions: URLs, hashes, verdicts, dates, markup. All are built-in Spark expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"(utm_[^=&]*|gclid|fbclid|ref|ref_src|mc_cid|mc_eid)"


def host(url: Column, default: str | None = "unknown") -> Column:
    """Host of an absolute URL in lower case without user and port; ``default`` if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(default)).otherwise(found)


def valid_feed_url(url: Column) -> Column:
    """True for absolute http and https URLs."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False))


def url_key(url: Column) -> Column:
    """Normal form for URL equality, null for URLs without a host.

    Rules: scheme, ``www.``, default port and fragment go; the host is lower-cased; tracking parameters
    go and the others are sorted; trailing slashes of the path go.
    """
    rest = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(rest, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    place = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(=|$)")))
    joined = F.concat(place, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host(url, None).isNotNull(), joined)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def title_domain_hash(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(host(url, None), F.lit("")), F.coalesce(title, F.lit(""))), 256)


def enough_bytes(text: Column, least: int = 100) -> Column:
    return F.coalesce(F.octet_length(F.trim(text)) >= least, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def rating(value: Column, default: int = 2) -> Column:
    """A trimmed small number, else ``default``."""
    number = F.try_to_number(F.trim(value), F.lit("999")).cast("int")
    return F.coalesce(F.when(number <= 255, number), F.lit(default))


def quality_score(sources: Column, argument: Column) -> Column:
    """Sum of both ratings' points: 1 gives -1, 2 gives 1, 3 gives 2, others 0."""
    points = lambda r: F.when(r == 1, -1).when(r == 2, 1).when(r == 3, 2).otherwise(0)
    return points(sources) + points(argument)


def says_yes(response: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(F.trim(response)), F.lit("yes")), F.lit(False))


def mentions_yes(response: Column) -> Column:
    return F.coalesce(F.contains(F.lower(response), F.lit("yes")), F.lit(False))


def strip_thinking(response: Column) -> Column:
    """Without ``<think>`` sections; the original where nothing else is left."""
    rest = F.trim(F.regexp_replace(response, r"(?s)<think>.*?</think>", ""))
    return F.when(rest == "", response).otherwise(rest)


def token_estimate(text: Column) -> Column:
    """Words, plus ASCII punctuation, plus half the words."""
    words = word_count(text)
    return words + F.coalesce(F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")), F.lit(0)) + F.floor(words / 2)


def too_long(text: Column, limit: int = 8192) -> Column:
    """Whether the estimate exceeds a model's context."""
    return token_estimate(text) > limit


def chat_markup(markdown: Column) -> Column:
    """Markdown to chat markup: bold, strikes, code blocks, headings, bullets, links, line ends, in this order."""
    steps = (
        (r"\*\*(.*?)\*\*", "*$1*"),
        (r"__(.*?)__", "*$1*"),
        (r"~~(.*?)~~", "~$1~"),
        (r"```(?:\s*\n)?(.*?)```", "```\n$1\n```"),
        (r"(?m)^#{1,3}[^\S\n]*([^\n]+)$", "*$1*"),
        (r"(?m)^[^\S\n]*[-*]\s+", "• "),
        (r"\[(.*?)\]\((.*?)\)", "<$2|$1>"),
        (r"\r\n?", "\n"),
        (r"\*{3,}(.+?)\*{3,}", "*$1*"),
    )
    for pattern, to in steps:
        markdown = F.regexp_replace(markdown, pattern, to)
    return markdown


def feed_time(value: Column) -> Column:
    """A feed's date as a timestamp: RFC 3339, RFC 2822, ISO with a compact offset, and naive forms as UTC.

    The shape of a text picks the one form it is parsed by.
    """
    text = F.trim(value)
    at = lambda t, p: F.try_to_timestamp(t, F.lit(p))
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    clock = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
    return (
        F.when(text.rlike(clock + r"(\.\d+)?([+-]\d{2}:\d{2}|Z)$"), at(F.regexp_replace(text, r"\.(\d{1,6})\d*", ".$1"), "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX"))
        .when(text.rlike(r"^([A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} "), at(mail, "d MMM yyyy HH:mm:ss XX"))
        .when(text.rlike(clock + r"[+-]\d{4}$"), at(text, "yyyy-MM-dd'T'HH:mm:ssXX"))
        .when(text.rlike(clock + "$"), at(text, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), at(text, "yyyy-MM-dd HH:mm:ss"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), at(text, "yyyy-MM-dd"))
    )


def lenient_date(value: Column, month_precision: bool = True) -> Column:
    """A date from many spellings; a bare ``yyyy-MM`` is its first day (or January 1 without ``month_precision``).

    The shape of a text picks the form; day/month/year comes before month/day/year where both are possible.
    """
    text = F.trim(value)
    day = lambda t, p: F.try_to_timestamp(t, F.lit(p)).cast("date")
    year = F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int")
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    quarter = F.regexp_extract(text, r"^\d{4}-[Qq]([1-4])$", 1).try_cast("int")
    iso = F.substring(text, 1, 10)
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.coalesce(day(iso, "yyyy-MM-dd"), new_year))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.coalesce(day(text, "yyyy/M/d"), new_year))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.coalesce(day(text, "d/M/yyyy"), day(text, "M/d/yyyy")))
        .when(text.rlike(r"^\p{L}+ \d{1,2}, \d{4}$"), day(text, "MMMM d, yyyy"))
        .when(text.rlike(r"^\d{1,2} \p{L}+ \d{4}$"), day(text, "d MMMM yyyy"))
        .when(text.rlike(r"^\d{4}-[Qq][1-4]$"), F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1)))
        .when(text.rlike(r"^\d{4}-\d{2}$") & F.lit(month_precision), F.coalesce(day(F.concat(text, F.lit("-01")), "yyyy-MM-dd"), new_year))
        .when(text.rlike(r"^\d{4}"), new_year)
    )


def event_date_in(text: Column) -> Column:
    """The first date spelled out in a text: month name first, then ISO, then day/month/year; null if none."""
    months = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    found = [F.regexp_extract(text, p, 0) for p in (rf"{months}\s+\d{{1,2}},\s+\d{{4}}", r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def temporal_proximity(a: Column, b: Column) -> Column:
    """1.0 on the same day, falling in steps to 0.1 within a year; 0 beyond or where a date is missing."""
    days = F.abs(F.datediff(a, b))
    score = F.lit(0.0)
    for limit, value in ((365, 0.1), (90, 0.3), (30, 0.5), (7, 0.7), (1, 0.9), (0, 1.0)):
        score = F.when(days <= limit, F.lit(value)).otherwise(score)
    return F.coalesce(score, F.lit(0.0))


def entity_type(value: Column) -> Column:
    upper = F.upper(F.trim(value))
    return F.when(upper.isin("PERSON", "ORGANIZATION", "LOCATION", "EVENT", "PRODUCT", "DATE"), upper).otherwise(F.lit("OTHER"))


def importance(value: Column) -> Column:
    upper = F.upper(F.trim(value))
    return F.when(upper.isin("PRIMARY", "SECONDARY"), upper).otherwise(F.lit("MENTIONED"))


def name_key(name: Column) -> Column:
    """Lower case, letters, digits and spaces only."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", ""))


def device_token(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))


# The weights of both scores.
def entity_score(person: Column, organization: Column, location: Column, event: Column, product: Column, near: Column) -> Column:
    return 0.25 * person + 0.2 * organization + 0.1 * location + 0.1 * event + 0.2 * product + 0.15 * near


def final_score(vector: Column, entity: Column) -> Column:
    """0.6 of the vector score and 0.4 of the entity score, where there is one."""
    return 0.6 * vector + F.coalesce(0.4 * entity, F.lit(0.0))


def as_time(moment: str) -> Column:
    """A literal without time zone for ``as_of`` arguments."""
    return F.lit(datetime.fromisoformat(moment)).cast("timestamp_ntz")

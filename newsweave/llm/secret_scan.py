"""Secret scanning with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query: clauses that must all hold, each an OR of
alternatives, each an AND of trigrams. The index holds postings ``(trigram, document)`` for the trigrams
that queries name, taken from the whole lower-cased text. Postings are intersected per rule, and only
candidate documents are verified with the expression. Rules without a mandatory trigram scan every text.

Scale. Postings meet per document, so a frequent trigram spreads over all partitions. Candidates go back
to the texts by broadcast only after a count has bounded them, else by a shuffled join.

Edge cases. A null text is empty and has no span. Repeated rows are scanned each; rows that share an id
but not the text are told apart by a text hash. Null ids, extra columns and empty tables are fine.
Offsets are code points, ends exclusive. Expressions are linear on runs, so long texts stay cheap.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as regex_parser
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm.words import bind
from newsweave.plans.durable import broadcast_if_small, durable

MAX_BROADCAST_CANDIDATES = 1_000_000
MAX_STRINGS = 128
BLOCK = 256  # matches whose offsets are added up one after another
MAX_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans of ``pattern``; ``group`` and ``at_least`` drop matches whose group is shorter."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    base: bool = False


# The base kinds first, in their listed order, then the kinds that the method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

Alternative = frozenset[str]


def _class_members(items) -> list[str] | None:
    found: list[str] = []
    for op, value in items:
        if op is ops.LITERAL:
            found.append(chr(value))
        elif op is ops.RANGE and value[1] - value[0] < MAX_CLASS:
            found += map(chr, range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= MAX_CLASS else None


class _Query:
    """Collects clauses while it walks along a concatenation; ``heads`` are the literal runs that may stand here."""

    def __init__(self) -> None:
        self.clauses: list[frozenset[Alternative]] = []
        self.heads = {""}

    def flush(self) -> None:
        options = frozenset(frozenset(h[i : i + 3] for i in range(len(h) - 2)) for h in self.heads)
        if all(options):
            self.clauses.append(options)
        self.heads = {""}

    def extend(self, tails: Iterable[str]) -> None:
        tails = set(tails)
        if len(self.heads) * len(tails) > MAX_STRINGS:
            self.flush()
        self.heads = {h + t for h in self.heads for t in tails}

    def walk(self, sequence) -> None:
        for op, value in sequence:
            exact = _exact([(op, value)])
            if exact is not None:
                self.extend(exact)
            elif op is ops.SUBPATTERN:
                self.walk(value[3])
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] >= 1:
                once = _exact(value[2])
                if once is None:
                    self.flush()
                else:
                    self.extend(once)
                    self.flush()
            else:
                self.flush()


def _exact(sequence) -> set[str] | None:
    """All strings of a finite, small expression; None for any other."""
    strings = {""}
    for op, value in sequence:
        if op is ops.LITERAL:
            part: set[str] | None = {chr(value)}
        elif op is ops.IN:
            members = _class_members(value)
            part = set(members) if members else None
        elif op is ops.SUBPATTERN:
            part = _exact(value[3])
        elif op is ops.BRANCH:
            options = [_exact(x) for x in value[1]]
            part = None if None in options else set().union(*options)
        elif op is ops.MAX_REPEAT and value[0] <= value[1] <= 1:
            inner = _exact(value[2])
            part = None if inner is None else inner | {""} if value[0] == 0 else inner
        elif op is ops.MAX_REPEAT and value[0] == value[1] and value[1] <= 8:
            part = _exact(list(value[2]) * value[1])
        else:
            part = None
        if part is None or len(strings) * len(part) > MAX_STRINGS:
            return None
        strings = {s + p for s in strings for p in part}
    return strings


def trigram_query(pattern: str) -> list[frozenset[Alternative]]:
    """Clauses over lower-case trigrams that every text matching ``pattern`` fulfils; none: scan fully."""
    query = _Query()
    query.walk(regex_parser.parse(pattern))
    query.flush()
    lowered = [frozenset(frozenset(t.lower() for t in option) for option in clause) for clause in query.clauses]
    return list(dict.fromkeys(lowered))


def spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end>>`` of the leftmost non-overlapping matches, failing ones dropped."""
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.split(text, rule.pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("groups")
    )

    empty = F.array().cast("array<struct<start:int,end:int>>")

    def placed(m: Column) -> Column:
        """Offsets are running sums: of blocks of matches first, then within each block, so that no long array grows step by step."""
        n = F.size(m["hits"])
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

        def step(done: Column, i: Column) -> Column:
            start = done["at"] + F.length(F.get(m["between"], i))
            end = start + F.length(F.get(m["hits"], i))
            keep = F.length(F.get(m["groups"], i)) >= rule.at_least
            one = F.array(F.struct(start.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(keep, F.concat(done["out"], one)).otherwise(done["out"]).alias("out"))

        def of_blocks(begins: Column) -> Column:
            one = lambda b: F.aggregate(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, n) - 1), F.struct(F.get(begins, b).alias("at"), empty.alias("out")), step)["out"]
            return F.flatten(F.transform(blocks, one))

        sizes = F.transform(blocks, lambda b: F.aggregate(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, n) - 1), F.lit(0), lambda x, i: x + F.length(F.get(m["between"], i)) + F.length(F.get(m["hits"], i))))
        grow = lambda done, x: F.struct((done["at"] + x).alias("at"), F.array_append(done["out"], done["at"]).alias("out"))
        begins = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), grow)["out"]
        return F.when(n == 0, empty).otherwise(bind(begins, of_blocks))

    return bind(found, placed)


def candidates(keyed: DataFrame) -> DataFrame:
    """``doc_id, text_key, rules``: documents whose postings satisfy the queries of some rules."""
    spark: SparkSession = keyed.sparkSession
    rows, clauses = [], {}
    for rule in RULES:
        query = trigram_query(rule.pattern)
        clauses[rule.kind] = len(query)
        for c, clause in enumerate(query):
            for a, option in enumerate(sorted(clause, key=sorted)):
                rows += [(rule.kind, c, a, len(option), t) for t in sorted(option)]
    terms = spark.createDataFrame(rows, "kind string, clause int, option int, terms long, trigram string")
    trigrams = sorted({r[4] for r in rows})
    lowered = keyed.select("doc_id", "text_key", F.lower("text").alias("low"))
    named = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    postings = lowered.select("doc_id", "text_key", F.explode(named).alias("trigram")).distinct()
    options = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "text_key", "kind", "clause", "option").agg(F.count("*").alias("met"), F.first("terms").alias("terms"))
    held = options.where("met = terms").groupBy("doc_id", "text_key", "kind").agg(F.countDistinct("clause").alias("clauses"))
    need = F.create_map(*[x for k, n in clauses.items() for x in (F.lit(k), F.lit(n))])
    return held.where(F.col("clauses") == need[F.col("kind")]).groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("rules"))


def _named(found: Column, order: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scanned(docs: DataFrame, keep: bool = False) -> DataFrame:
    """``doc_id, text, found`` for each row of ``docs``: all spans by start, then kind as listed.

    With ``keep`` the other columns of ``docs`` come along in the struct ``row``, and ``was_null`` for the text.
    """
    whole = [F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["text"].isNull().alias("was_null")] if keep else []
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *whole).withColumn("text_key", F.xxhash64("text"))
    chosen = durable(candidates(keyed), "candidates").select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "rules")
    joined = keyed.join(broadcast_if_small(chosen, MAX_BROADCAST_CANDIDATES), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left")
    text = F.col("text")
    lists = []
    for order, rule in enumerate(RULES):
        picked = F.array_contains("rules", rule.kind) if trigram_query(rule.pattern) else text.rlike(rule.pattern)
        lists.append(F.when(picked, _named(spans(text, rule), order, rule.kind)).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")))
    return joined.select("doc_id", "text", *(["row", "was_null"] if keep else []), F.array_sort(F.flatten(F.array(*lists))).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, a count per base kind, ``base_sha256`` and ``spans`` for each row of ``docs``."""
    base = [r.kind for r in RULES if r.base]
    rows = scanned(docs)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *map(count, base), F.sha2(_joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every kind replaced by ``mark`` (overlapping spans by one mark); ``n_chars`` follows."""

    def cut(text: Column, found: Column) -> Column:
        def step(done: Column, s: Column) -> Column:
            gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
            fresh = s["start"] >= done["at"]
            return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, F.concat(done["out"], F.array(gap, F.lit(mark)))).otherwise(done["out"]).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        parts = F.aggregate(found, begin, step)
        return bind(parts, lambda p: F.concat(F.array_join(p["out"], ""), F.substring(text, p["at"] + 1, F.length(text))))

    rows = scanned(docs, keep=True)
    none = F.size("found") == 0
    new = {"text": F.when(F.col("was_null"), F.lit(None).cast("string")).when(none, F.col("text")).otherwise(cut(F.col("text"), F.col("found")))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(none, F.col("row.n_chars")).otherwise(F.length(new["text"]).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def _spans_sql(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, place AS s, place + length(hits[i]) AS e FROM (
  SELECT *, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS place FROM (
  SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits,
  regexp_extract_all(text, '{pattern}', {rule.group}) AS parts FROM t))) WHERE length(parts[i]) >= {rule.at_least}"""


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(o, r) for o, r in enumerate(RULES))}),
g AS (SELECT doc_id, count_if(ord = 0)::BIGINT AS n_assign, count_if(ord = 1)::BIGINT AS n_access, count_if(ord = 2)::BIGINT AS n_hex,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON g.doc_id = t.doc_id
"""

"""Host-level quality rules, in DataFrame functions only.

Every document is measured on its whole text. Rule failures are counted per host (``source``), each
host's failure rate is shrunk by a beta prior, and hosts whose shrunk rate exceeds ``MAX_HOST_RATE`` for any
rule lose their documents.

The prior is fitted by moments of the beta-binomial distribution. Its mean is the failure rate of all documents
(so hosts count by their documents). What hosts differ by is corrected for what chance makes hosts of their
sizes differ by; the rest, as a share of the largest possible spread, is the correlation ``r`` of two
documents of one host, and ``a + b = (1 - r) / r``. With ``r = 0`` hosts do not differ and every rate is the mean.
The prior weighs at least ``MIN_PRIOR_DOCS`` documents, because a few large hosts that differ much can put ``r`` near 1.

Scale. One pass over the texts writes a narrow table of counts; hosts come from a partial aggregation,
so a host that holds a third of all rows is summed up on the map side. The verdicts are joined back by
broadcast only after a count has bounded them, otherwise by a shuffled join of narrow rows that adaptive
execution may split.

Edge cases. A null text has no words and fails. Null hosts form one group of their own. An empty table
gives no row. Repeated rows are judged and returned each. One host alone, or hosts of one document each, say
nothing about how hosts differ, and neither does a rule that all documents fail or none: ``r`` is 0 then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.words import SPACES, bind, split_words
from newsweave.plans.durable import broadcast_if_small, durable, scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.5
MAX_HOST_RATE = 0.5
MIN_PRIOR_DOCS = 1
MAX_BROADCAST_HOSTS = 100_000
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repetitive", "symbols")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in ``words``.

    Windows are compared by a 64-bit hash. Sorted with their positions, equal windows are neighbours;
    the covered words are then counted along the positions of those windows. O(n log n) for n words.
    """

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.array_sort(  # noqa: E731  get() beyond either end is null, which a filter takes as false
            F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"])
        )
        length = lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - p), F.lit(3))), F.lit(0), lambda a, b: a + b
        )
        return bind(pairs, lambda s: bind(twice(s), length))

    windows = bind(
        words,
        lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measures(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source`` and the counts of the whole text of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = docs.select("doc_id", "source", *extra, text.alias("text")).select(
        "doc_id",
        "source",
        *extra,
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bind(split_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
    )
    return counted.select("doc_id", "source", *extra, "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def host_verdicts(measured: DataFrame) -> DataFrame:
    """``source, n_docs, rate_<rule>, host_kept``: failure rates per host after shrinkage."""
    fails = {
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"),
    }
    hosts = measured.groupBy("source").agg(F.count("*").alias("n_docs"), *[F.count_if(c).alias(f"fails_{r}") for r, c in fails.items()])
    hosts = durable(hosts, "hosts")
    n = F.col("n_docs").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares")]
    for r in RULES:
        f = F.col(f"fails_{r}").cast("double")
        sums += [F.sum(f).alias(f"sum_{r}"), F.sum(f * f / n).alias(f"between_{r}")]
    total = hosts.agg(*sums)  # one row
    prior = []
    for r in RULES:
        mean = F.col(f"sum_{r}") / F.col("docs")
        largest = mean * (1 - mean)
        spread = F.col(f"between_{r}") - F.col(f"sum_{r}") * mean  # of host rates around the mean, by documents
        chance = F.col("hosts") - 1
        room = F.col("docs") - F.col("squares") / F.col("docs") - chance
        share = F.when((largest > 0) & (room > 0), (spread / largest - chance) / room).otherwise(F.lit(0.0))
        prior += [mean.alias(f"mean_{r}"), F.least(F.greatest(share, F.lit(0.0)), F.lit(1 / (1 + MIN_PRIOR_DOCS))).alias(f"share_{r}")]
    rates = []
    for r in RULES:  # (fails + a) / (n + a + b), numerator and denominator times r
        share, own = F.col(f"share_{r}"), F.col(f"fails_{r}")
        rates.append(((own * share + F.col(f"mean_{r}") * (1 - share)) / (n * share + 1 - share)).alias(f"rate_{r}"))
    rated = hosts.join(F.broadcast(total.select(*prior))).select("source", "n_docs", *rates)
    return rated.withColumn("host_kept", F.greatest(*[f"rate_{r}" for r in RULES]) <= MAX_HOST_RATE)


def _verdicts(measured: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``, ``host_kept`` and ``kept``."""
    with scratch(measured.sparkSession) as keep:
        verdicts = keep(durable(host_verdicts(measured).select(F.col("source").alias("host"), "host_kept"), "verdicts"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    joined = measured.join(broadcast_if_small(verdicts, MAX_BROADCAST_HOSTS), F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.withColumns({"base_failed": base, "kept": ~base & F.col("host_kept")})


def judged(docs: DataFrame) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of each row of ``docs`` (``doc_id, text, source``)."""
    rows = _verdicts(durable(measures(docs), "measures"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", "host_kept")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; each row goes by its own text, whatever its id."""
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _verdicts(durable(measures(whole, ("row",)), "measures")).where("kept")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
h AS (SELECT source, count(*) AS n, count_if(n_words < 50) AS f1, count_if(100 * n_repeat_words > 50 * n_words) AS f2, count_if(n_symbols > 0.5 * n_words) AS f3 FROM m GROUP BY source),
t AS (SELECT count(*) AS hosts, sum(n)::DOUBLE AS docs, sum(n * n)::DOUBLE AS squares FROM h),
p AS (SELECT k, sum(f)::DOUBLE / sum(n)::DOUBLE AS m, sum(f::DOUBLE * f / n) - sum(f)::DOUBLE * sum(f)::DOUBLE / sum(n)::DOUBLE AS spread
      FROM (SELECT n, unnest([1, 2, 3]) AS k, unnest([f1, f2, f3]) AS f FROM h) GROUP BY k),
q AS (SELECT k, m, CASE WHEN m * (1 - m) > 0 AND docs - squares / docs - (hosts - 1) > 0
      THEN least(greatest((spread / (m * (1 - m)) - (hosts - 1)) / (docs - squares / docs - (hosts - 1)), 0.0), 0.5) ELSE 0.0 END AS r FROM p, t),
v AS (SELECT source, max((f * r + m * (1 - r)) / (n * r + 1 - r)) <= 0.5 AS host_kept
      FROM (SELECT source, n, unnest([1, 2, 3]) AS k, unnest([f1, f2, f3]) AS f FROM h) JOIN q USING (k) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND host_kept AS kept, m.source, host_kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""

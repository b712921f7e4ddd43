"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window).
For exact containment of a window of k words, k - k + 1 = 1 prefix token suffices: its rarest word in the
corpus. Document words are joined with those prefix tokens; the token's position gives the only place
where the window could stand (positional bound), which must lie inside the document (length bound), and
the item-sized stretch of words there is compared with the window.

Scale. Only occurrences of prefix tokens leave the scan, with the few words of their window. Texts are cut into
blocks of words first, so that a word travels with the words of its block and never with all of its document. Benchmark tables
are broadcast only after a count of rows and bytes has bounded them; where the prefix tokens are too many,
narrow word positions are shuffled, and each text once to meet its own candidates. Hits meet per document,
never per item or window, so a passage that many documents share does not gather in one task.

Edge cases. Null texts have no words. A null item id is left out of the id list but its windows hit.
Repeated items and windows count once; repeated documents give one row each, and rows that share an id
but not the text are told apart by a text hash. Empty tables on either side give 0 hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.words import bind, count_words, lower_ascii, split_words, unused_names
from newsweave.plans.durable import broadcast_if_small, durable, is_small, scratch

WINDOW = 10
BLOCK = 128
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), GAP)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``window`` (its words), ``item_id`` for each window of each item."""
    cut = lambda w: F.when(
        F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.slice(w, i, WINDOW))
    ).otherwise(F.when(F.size(w) > 0, F.array(w)).otherwise(F.array().cast("array<array<string>>")))
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.explode(bind(words_of(F.col("text")), cut)).alias("window")).distinct()


def prefix_tokens(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Each distinct window with ``window_id`` and its rarest word over all documents (``token``, ``offset``)."""
    distinct = windows.select("window").distinct().withColumn("window_id", F.xxhash64("window"))
    vocabulary = durable(distinct.select(F.explode("window").alias("token")).distinct(), "vocabulary")
    counted = docs.select(F.explode(words_of(F.col("text"))).alias("token")).join(broadcast_if_small(vocabulary, MAX_BROADCAST_ROWS), "token").groupBy("token").agg(F.count("*").alias("n"))
    terms = distinct.select("window", "window_id", F.posexplode("window").alias("offset", "token"))
    ranked = terms.join(broadcast_if_small(durable(counted, "counts"), MAX_BROADCAST_ROWS), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = ranked.groupBy("window_id", "window").agg(F.min(F.struct("n", "token", "offset")).alias("p"))
    return first.where("p.n > 0").select("p.token", "p.offset", "window", "window_id")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"text": F.coalesce("text", F.lit("")), "text_key": F.xxhash64(F.coalesce("text", F.lit("")))})


def word_blocks(words: Column, size: int = BLOCK, reach: int = WINDOW - 1) -> Column:
    """``array<struct<first, base, around>>``: ``size`` words from ``first`` on, with ``reach`` words before and after.

    ``around`` begins at word ``base``. No words give null.
    """

    def block(w: Column, first: Column) -> Column:
        base = F.greatest(first - reach, F.lit(0))
        return F.struct(first.alias("first"), base.alias("base"), F.slice(w, base + 1, first - base + size + reach).alias("around"))

    return bind(words, lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size)), lambda first: block(w, first))))


def _hits(keyed: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, width, window_id`` of every window that occurs in a document.

    A prefix word is joined together with the stretch of the document's words that its window would fill, and
    with nothing else of the document.
    """
    prefix = durable(prefix_tokens(windows, keyed), "prefix")
    shapes = prefix.groupBy("token").agg(F.collect_set(F.struct("offset", F.size("window").alias("width"))).alias("shapes"))
    shapes = durable(shapes, "shapes")
    if is_small(shapes, MAX_BROADCAST_ROWS):
        blocks = keyed.select("doc_id", "text_key", F.inline(word_blocks(words_of(F.col("text")))))
        spread = blocks.select("*", F.posexplode("around").alias("at", "token")).where(F.col("at").between(F.col("first") - F.col("base"), F.col("first") - F.col("base") + (BLOCK - 1)))
        met = spread.join(F.broadcast(shapes), "token").select("doc_id", "text_key", "base", F.col("around").alias("words"), F.explode("shapes").alias("s"), (F.col("at") - F.col("s.offset")).alias("start"))
    else:
        words = keyed.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
        spread = words.select("doc_id", "text_key", F.posexplode("words").alias("at", "token"))
        places = spread.join(shapes, "token").select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), F.explode("shapes").alias("s"), (F.col("at") - F.col("s.offset")).alias("start"))
        places = places.groupBy("p_id", "p_key").agg(F.collect_set(F.struct("s", "start")).alias("places"))
        mine = words.join(places, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")))
        met = mine.select("doc_id", "text_key", F.lit(0).alias("base"), "words", F.explode("places").alias("p")).select("doc_id", "text_key", "base", "words", "p.s", "p.start")
    inside = met.where((F.col("start") >= 0) & (F.col("start") + F.col("s.width") <= F.size("words")))
    stretch = F.slice("words", F.col("start") + 1, F.col("s.width"))
    found = inside.select("doc_id", "text_key", (F.col("base") + F.col("start")).alias("start"), F.col("s.width").alias("width"), stretch.alias("window"))
    known = broadcast_if_small(prefix.select("window", "window_id"), MAX_BROADCAST_ROWS)
    return found.join(known, "window").select("doc_id", "text_key", "start", "width", "window_id").distinct()


def _contaminated(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``f_id, f_key, n_hit, items`` of each text in which a window occurs."""
    windows = durable(item_windows(benchmark), "windows")
    hits = durable(_hits(keyed, windows), "hits")
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.col("spans"), lambda s: F.sequence(s["start"], s["start"] + s["width"] - 1)))))
    by_doc = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "width")).alias("spans")).select("doc_id", "text_key", covered.cast("long").alias("n_hit"))
    owners = durable(windows.select(F.xxhash64("window").alias("window_id"), "item_id").where("item_id IS NOT NULL").distinct(), "owners")
    items = hits.select("doc_id", "text_key", "window_id").distinct().join(broadcast_if_small(owners, MAX_BROADCAST_ROWS), "window_id")
    items = items.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = by_doc.join(items, by_doc.doc_id.eqNullSafe(items.doc_id) & (by_doc.text_key == items.text_key), "left")
    return durable(found.select(by_doc.doc_id.alias("f_id"), by_doc.text_key.alias("f_key"), "n_hit", "items"), "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``."""
    keyed = _keyed(docs.select("doc_id", "text"))
    with scratch(docs.sparkSession) as keep:
        found = keep(_contaminated(keyed, benchmark))
        few = broadcast_if_small(found, MAX_BROADCAST_ROWS)
    counts = keyed.select("doc_id", "text_key", count_words(lower_ascii(F.col("text")), GAP).cast("long").alias("n_words"))
    joined = counts.join(few, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no window occurs, whatever their id."""
    by_id, by_key, own_key = unused_names(docs, "id", "key", "text_key")
    with scratch(docs.sparkSession) as keep:
        hits = _hits(_keyed(docs.select("doc_id", "text")), durable(item_windows(benchmark), "windows"))
        dirty = keep(durable(hits.select(F.col("doc_id").alias(by_id), F.col("text_key").alias(by_key)).distinct(), "dirty"))
        few = broadcast_if_small(dirty, MAX_BROADCAST_ROWS)
    keyed = docs.withColumn(own_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(few, F.col("doc_id").eqNullSafe(F.col(by_id)) & (F.col(own_key) == F.col(by_key)), "left_anti").drop(own_key)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
        FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.k = win.k AND g.words = win.words),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

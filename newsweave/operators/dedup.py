"""Ingestion filters: seen URLs, equal content, age routes, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.functions import text as T


def unseen(queue: DataFrame, seen: DataFrame, key: str = "normalized_url") -> DataFrame:
    """Queue rows whose key is not in ``seen``; rows without a key are errors and go."""
    return queue.where(F.col(key).isNotNull()).join(seen.select(key).distinct(), key, "left_anti")


def cleaned_queue(queue: DataFrame, articles: DataFrame, key: str = "normalized_url") -> tuple[DataFrame, DataFrame]:
    """The queue without rows that are articles already, and one row with the number of rows that went (``affected``)."""
    known = articles.select(key).distinct()
    return queue.join(known, key, "left_anti"), queue.join(known, key, "left_semi").agg(F.count("*").alias("affected"))


def taken(queue: DataFrame, n: int, order: str = "oldest", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The next ``n`` rows of the queue and the rest of it."""
    first = next_in_queue(queue, n, order, seed)
    return first, queue.join(first.select("normalized_url"), "normalized_url", "left_anti")


def next_in_queue(queue: DataFrame, n: int, order: str = "oldest", seed: int = 0) -> DataFrame:
    """The next ``n`` rows: oldest or newest first, or in a seeded random order; ties by key."""
    by = {"oldest": [F.asc("seen_at")], "newest": [F.desc("seen_at")], "random": [F.xxhash64("normalized_url", F.lit(seed))]}[order]
    return queue.orderBy(*by, "normalized_url").limit(n)


def mixed_draw(queue: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A draw of which 30 % are the newest, 25 % the oldest and the rest random among the others."""
    newest, oldest = round(0.3 * n), round(0.25 * n)
    first = next_in_queue(queue, newest, "newest")
    second = next_in_queue(queue.join(first, "normalized_url", "left_anti"), oldest, "oldest")
    rest = queue.join(first.unionByName(second), "normalized_url", "left_anti")
    return first.unionByName(second).unionByName(next_in_queue(rest, n - newest - oldest, "random", seed))


def queue_inserts(entries: DataFrame, queue: DataFrame, articles: DataFrame, key: str = "normalized_url") -> DataFrame:
    """Entries that are in neither table, one for each ``key`` (the first seen): a URL key for feeds, ``article_url`` for verdict queues."""
    fresh = entries.where(F.col(key).isNotNull())
    for known in (queue, articles):
        fresh = fresh.join(known.select(key).distinct(), key, "left_anti")
    first = Window.partitionBy(key).orderBy("seen_at", *["url"] if "url" in entries.columns else [])
    return fresh.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def unseen_titles(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Items whose title on that domain is not known yet; a known one is a duplicate even if its text differs.

    The hash is one of domain and title without a mark between them, so ``a1`` with title ``23`` and ``a12`` with ``3`` have the
    same. Where both sides have the ``domain``, it must agree too, and then the title does.
    """
    key = ["title_domain_hash", *(["domain"] if "domain" in items.columns and "domain" in articles.columns else [])]
    return items.join(articles.select(*key).where("title_domain_hash IS NOT NULL").distinct(), key, "left_anti")


def age_route(published: Column, as_of: Column, days: int) -> Column:
    """``stale`` when older than ``days``, else ``queue``; an unknown age passes."""
    return F.when(published < as_of - F.expr(f"INTERVAL {days} DAYS"), "stale").otherwise("queue")


def content_duplicates(articles: DataFrame) -> DataFrame:
    """``id, hash, copies, first_id, is_first`` by equal text. A null text is a group of its own per row."""
    hashed = articles.select("id", T.text_hash(F.col("text")).alias("hash"))
    groups = hashed.where("hash IS NOT NULL").groupBy("hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    joined = hashed.join(groups, "hash", "left")
    return joined.select("id", "hash", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("first_id", "id").alias("first_id"), (F.coalesce("first_id", "id") == F.col("id")).alias("is_first"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """Last write wins per key by ``order``; columns in ``kept`` keep the oldest value that is not null.

    One shuffle: both sides are one union with the rank of their row; repeating an upsert changes nothing.
    """
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (*keys, "__new")]
    latest = F.max_by(F.struct(*others), F.struct(F.col(order), F.col("__new")))
    stay = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("__new"), F.col(order)))).alias(f"__kept_{c}") for c in kept]
    merged = both.groupBy(*keys).agg(latest.alias("row"), *stay)
    value = lambda c: F.coalesce(F.col(f"__kept_{c}"), F.col("row")[c]).alias(c) if c in kept else F.col("row")[c].alias(c)
    return merged.select(*keys, *map(value, others))

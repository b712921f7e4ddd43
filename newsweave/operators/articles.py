"""Reads of article records whose analysis is a JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.functions import text as T


def article_text(articles: DataFrame) -> DataFrame:
    """``id, text``: the analysis' body, else the raw analysis, else the short summary, else empty."""
    return articles.select("id", F.coalesce(F.get_json_object("analysis", "$.article_body"), "analysis", "tiny_summary", F.lit("")).alias("text"))


def article_details(articles: DataFrame) -> DataFrame:
    """``id, category, quality, title, tiny_summary, event_date, r2_url``; quality 0 where it is missing."""
    get = lambda k: F.get_json_object("analysis", f"$.{k}")
    quality = F.coalesce(get("quality").try_cast("int"), F.lit(0))
    return articles.select("id", "category", quality.alias("quality"), get("tiny_title").alias("title"), "tiny_summary", T.lenient_date(get("pub_date")).alias("event_date"), (F.col("r2_url") if "r2_url" in articles.columns else F.lit(None).cast("string")).alias("r2_url"))


def backfill_input(articles: DataFrame) -> DataFrame:
    """``id, text, pub_date, status`` for entity extraction; records without a readable summary are failures."""
    parsed = F.from_json("analysis", "summary STRING, pub_date STRING")
    rows = articles.select("id", parsed["summary"].alias("text"), parsed["pub_date"].alias("pub_date"))
    return rows.withColumn("status", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "failed").otherwise("ok"))


def cluster_listing(clusters: DataFrame, status: str | None = None, order: str = "importance_score", limit: int = 20) -> DataFrame:
    """Clusters with a 100-character preview of their summary, highest ``order`` first."""
    rows = clusters if status is None else clusters.where(F.col("status") == status)
    return rows.withColumn("preview", F.substring("summary", 1, 100)).drop("summary").orderBy(F.desc(order), "id").limit(limit)


def needing_summary(clusters: DataFrame) -> DataFrame:
    return clusters.where("needs_summary_update").orderBy(F.desc("last_updated"), "id")


def run_counters(outcomes: DataFrame) -> DataFrame:
    """How often each outcome of a run occurred."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def with_delivery(articles: DataFrame, uploads: DataFrame) -> DataFrame:
    """``articles`` with the ``r2_url`` of the latest upload (``normalized_url, r2_url, at``) of their URL, else their own."""
    last = uploads.where("r2_url IS NOT NULL").groupBy("normalized_url").agg(F.max_by("r2_url", "at").alias("new_url"))
    return articles.join(last, "normalized_url", "left").withColumn("r2_url", F.coalesce("new_url", "r2_url")).select(*articles.columns)


def with_event_dates(articles: DataFrame, found: DataFrame) -> DataFrame:
    """``articles`` with the event date found for them (``id, event_date``) where it is not blank."""
    new = found.where("trim(event_date) <> ''").groupBy("id").agg(F.max("event_date").alias("new_date"))
    return articles.join(new, "id", "left").withColumn("event_date", F.coalesce("new_date", "event_date")).select(*articles.columns)


def labelled_corpus(spark, path: str) -> DataFrame:
    """``file, title, body, topic, relevant`` of labelled articles: JSON objects ``{title, body, relevance: {topic: Yes or No}}``."""
    rows = spark.read.schema("title STRING, body STRING, relevance MAP<STRING, STRING>").json(path, multiLine=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.select("file", "title", "body", F.explode("relevance").alias("topic", "answer")).select("file", "title", "body", "topic", T.says_yes(F.col("answer")).alias("relevant"))

"""Similar articles: vector hits and shared-entity candidates, scored, with near misses and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.functions import text as T
from newsweave.operators import entities as EN
from newsweave.operators import matching as MA
from newsweave.operators.vectors import cosine, cosine_top_k, norm, recent
from newsweave.plans.durable import durable


def candidate_union(vector_hits: DataFrame, entity_hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """``source_id, target_id, vector_score``: both candidate sets; entity-only pairs get their exact cosine, 0 without vectors."""
    both = vector_hits.select("source_id", "target_id", F.col("score").alias("found")).join(entity_hits.select("source_id", "target_id"), ["source_id", "target_id"], "full_outer")
    known = both.where("found IS NOT NULL").select("source_id", "target_id", F.col("found").alias("vector_score"))
    side = lambda s: vectors.select(F.col("id").alias(f"{s}_id"), F.col("embedding").alias(s))
    rest = both.where("found IS NULL").join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    return known.unionByName(rest.select("source_id", "target_id", F.coalesce(cosine(F.col("source"), F.col("target")), F.lit(0.0)).alias("vector_score")))


# The wording of reasons and defaults.
def near_miss_reason(overlap: Column, entity: Column, vector: Column) -> Column:
    return (
        F.when(overlap == 0, "No entity overlap")
        .when(entity < 0.3, F.format_string("Weak entity similarity (%.2f)", entity))
        .when(vector < 0.5, F.format_string("Low vector similarity (%.2f)", vector))
        .otherwise("Combined score below threshold")
    )


def pair_reason(overlap: Column, entity: Column, vector: Column, score: Column, threshold: float) -> Column:
    """The order of the pair tools: no overlap, vector, entity, combined."""
    return (
        F.when(score >= threshold, "Match success")
        .when(overlap == 0, "No shared entities")
        .when(vector < 0.5, F.format_string("Low vector similarity (%.2f)", vector))
        .when(entity < 0.3, F.format_string("Weak entity similarity (%.2f)", entity))
        .otherwise(F.format_string("Combined score below threshold (needs %.2f more)", F.lit(threshold) - score))
    )


def similar_articles(candidates: DataFrame, entity_scores: DataFrame, threshold: float, k: int) -> DataFrame:
    """Every candidate with its final score: ``status`` is ``match`` (ranked up to ``k``) or ``near_miss`` with a reason.

    ``candidates``: ``source_id, target_id, vector_score``. ``entity_scores``: ``source_id, target_id,
    overlap, entity_score``; pairs without a row share nothing and keep 0.6 of the vector score.
    """
    rows = candidates.where("source_id <> target_id").join(entity_scores, ["source_id", "target_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    rows = rows.withColumn("score", T.final_score(F.col("vector_score"), F.col("entity_score")))
    order = Window.partitionBy("source_id", F.col("score") >= threshold).orderBy(F.desc("score"), "target_id")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    miss = F.col("score") < threshold
    entity = F.coalesce("entity_score", F.lit(0.0))
    return rows.select(
        "source_id", "target_id", "overlap", "vector_score", entity.alias("entity_score"), "score", "rank", F.when(miss, "near_miss").otherwise("match").alias("status"),
        F.when(miss, F.lit(threshold) - F.col("score")).alias("missing"), F.when(miss, near_miss_reason(F.col("overlap"), entity, F.col("vector_score"))).alias("reason"),
    )


def pair_analysis(pairs: DataFrame, vectors: DataFrame, entity_scores: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Metrics, verdict and reason of given pairs; the scores of pairs without vectors or entities are 0."""
    side = lambda s: vectors.select(F.col("id").alias(f"{s}_id"), F.col("embedding").alias(s))
    rows = pairs.join(side("source"), "source_id", "left").join(side("target"), "target_id", "left").join(entity_scores, ["source_id", "target_id"], "left")
    vector = F.coalesce(cosine(F.col("source"), F.col("target")), F.lit(0.0))
    rows = rows.withColumn("vector_score", vector).withColumn("entity_score", F.coalesce("entity_score", F.lit(0.0))).withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    rows = rows.withColumn("score", 0.6 * F.col("vector_score") + 0.4 * F.col("entity_score"))
    return rows.drop("source", "target").withColumn("is_match", F.col("score") >= threshold).withColumn("reason", pair_reason(F.col("overlap"), F.col("entity_score"), F.col("vector_score"), F.col("score"), threshold))


ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT", "PRODUCT")


def source_day(event_date: Column, pub_date: Column) -> Column:
    """The day an article is compared by: its event date, else its publication date."""
    return F.coalesce(event_date.cast("date"), pub_date.cast("date"))


def entity_metrics(pairs: DataFrame, named_links: DataFrame, matches: DataFrame, days: DataFrame) -> DataFrame:
    """Entity similarity of article pairs (``source_id, target_id``), as far as both articles have entities.

    ``named_links``: ``article_id, entity_id, name, type, importance``; ``matches``: ``name_a, type_a, name_b, type_b`` of
    names that are taken for one; ``days``: ``article_id, day``. Columns: a score for each type (greedy one-to-one),
    ``overlap``, ``primary_overlap``, ``proximity`` of the days and ``entity_score``.
    """
    order = Window.partitionBy("article_id", "type").orderBy("importance", "name", "entity_id")
    ranked = named_links.withColumn("r", F.row_number().over(order))
    side = lambda s: ranked.select(
        F.col("article_id").alias("source_id" if s == "s" else "target_id"), F.col("name").alias(f"name_{'a' if s == 's' else 'b'}"), F.col("type").alias(f"type_{'a' if s == 's' else 'b'}"), F.col("r").alias(f"{s}_rank"), F.col("importance").alias(f"{s}_importance")
    )
    met = durable(pairs.join(side("s"), "source_id").join(matches, ["name_a", "type_a"]).join(side("t"), ["target_id", "name_b", "type_b"]), "met")
    sizes = named_links.groupBy("article_id", "type").agg(F.count("*").alias("n"))
    sized = lambda s: sizes.select(F.col("article_id").alias(f"{s}_id"), "type", F.col("n").alias(f"n_{s}"))
    both = pairs.join(sized("source"), "source_id").join(sized("target"), ["target_id", "type"])
    edges = met.where("type_a = type_b").withColumnRenamed("type_a", "type")
    scores = MA.greedy_similarity(edges, both)
    wide = scores.groupBy("source_id", "target_id").agg(*[F.coalesce(F.max(F.when(F.col("type") == t, F.col("score"))), F.lit(0.0)).alias(t.lower()) for t in ENTITY_TYPES])
    primary = (F.col("s_importance") == "PRIMARY") & (F.col("t_importance") == "PRIMARY")
    source = F.struct("type_a", "s_rank")
    overlaps = met.groupBy("source_id", "target_id").agg(F.countDistinct(source).alias("overlap"), F.countDistinct(F.when(primary, source)).alias("primary_overlap"))
    has = lambda s: named_links.select(F.col("article_id").alias(f"{s}_id")).distinct()
    day = lambda s: days.select(F.col("article_id").alias(f"{s}_id"), F.col("day").alias(f"{s}_day"))
    rows = pairs.join(has("source"), "source_id").join(has("target"), "target_id").join(wide, ["source_id", "target_id"], "left").join(overlaps, ["source_id", "target_id"], "left")
    rows = rows.join(day("source"), "source_id", "left").join(day("target"), "target_id", "left").na.fill(0.0, [t.lower() for t in ENTITY_TYPES]).na.fill(0, ["overlap", "primary_overlap"])
    rows = rows.withColumn("proximity", T.temporal_proximity(F.col("source_day"), F.col("target_day")))
    score = T.entity_score(*[F.col(t.lower()) for t in ENTITY_TYPES], F.col("proximity"))
    return rows.select("source_id", "target_id", *[t.lower() for t in ENTITY_TYPES], "overlap", "primary_overlap", "proximity", score.alias("entity_score"))


def combined_search(
    vectors: DataFrame, articles: DataFrame, links: DataFrame, names: DataFrame, matches: DataFrame, sources: DataFrame, as_of: str,
    k: int = 10, vector_threshold: float = 0.80, threshold: float = 0.70, days: int = 14, window: tuple[int, int] = (14, 1),
) -> DataFrame:
    """Similar articles of every source (``article_id``): vector hits and shared-entity candidates in one ranking.

    ``vectors``: ``id, embedding, published``; ``articles``: ``id, pub_date, event_date``; ``links``: ``article_id, entity_id,
    importance``; ``names``: ``entity_id, name, type``; ``matches``: pairs of names taken for one. Both branches fetch ``2 k``
    candidates; pairs found by entities alone get their exact cosine. Pairs whose target has no entities keep
    0.6 of the vector score. ``status`` is ``match`` (the best ``k``) or ``near_miss`` with a reason.
    """
    own = vectors.join(sources.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi").select("id", "embedding")
    hits = durable(cosine_top_k(own, recent(vectors, as_of, days).select("id", "embedding"), 2 * k, vector_threshold), "vector-hits")
    shared = EN.grouped_candidates(links, sources, EN.candidate_dates(articles), window, 2 * k)
    valid = vectors.where(norm(F.col("embedding")) >= 0.001)
    candidates = durable(candidate_union(hits, shared, valid), "candidates")
    named = links.join(names.select("entity_id", "name", "type"), "entity_id").select("article_id", "entity_id", "name", "type", "importance")
    when = articles.select(F.col("id").alias("article_id"), source_day(F.col("event_date"), F.col("pub_date")).alias("day"))
    metrics = durable(entity_metrics(candidates.select("source_id", "target_id"), named, matches, when), "metrics")
    ranked = similar_articles(candidates, metrics.select("source_id", "target_id", "overlap", "entity_score"), threshold, k)
    return ranked.join(metrics.drop("overlap", "entity_score"), ["source_id", "target_id"], "left")


def with_details(similar: DataFrame, details: DataFrame) -> DataFrame:
    """``similar`` with what a reader is shown of each target; a target without a record keeps its row with defaults.

    ``details``: ``id, json_url, title, tiny_summary, category, published_date, quality``.
    """
    d = details.select(F.col("id").alias("target_id"), "json_url", "title", "tiny_summary", "category", "published_date", F.col("quality").alias("quality_score"))
    rows = similar.join(d, "target_id", "left")
    # What stands for a missing field.
    text = {"json_url": "Unknown URL", "title": "Unknown Title", "tiny_summary": "", "category": "", "published_date": ""}
    numbers = {"quality_score": 0, "vector_score": 0.0, "overlap": 0, "primary_overlap": 0, "person": 0.0, "organization": 0.0, "location": 0.0, "event": 0.0, "proximity": 0.0}
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in text.items()} | {c: F.coalesce(c, F.lit(v)) for c, v in numbers.items() if c in rows.columns}
    formula = F.format_string("60%% vector similarity (%.2f) + 40%% entity similarity (%.2f)", F.coalesce("vector_score", F.lit(0.0)), F.coalesce("entity_score", F.lit(0.0))) if "entity_score" in rows.columns else F.lit("60% vector similarity (no entity data available)")
    return rows.withColumns(filled).withColumn("similarity_formula", formula)

"""Domain views over the star-schema tables that stand in for articles, entities, devices and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, pub_date, category, is_relevant, quality, r2_url`` from orders; quality from the price band.

    One in thirteen has no category, one in nine was not delivered.
    """
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("pub_date"),
        F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderpriority")).alias("category"),
        (F.col("o_orderstatus") != "P").alias("is_relevant"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("quality"),
        F.when(F.col("o_custkey") % 9 != 0, F.concat(F.lit("https://store.example/"), F.col("o_orderkey"))).alias("r2_url"),
    )


ARTICLES_SQL = """article AS (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP AS pub_date, CASE WHEN o_orderkey % 13 > 0 THEN o_orderpriority END AS category,
  o_orderstatus <> 'P' AS is_relevant, floor(o_totalprice / 100000)::INT AS quality, CASE WHEN o_custkey % 9 <> 0 THEN 'https://store.example/' || o_orderkey END AS r2_url FROM orders)"""


def article_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``article_id, entity_id, importance`` from order lines; the first line's supplier is primary."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("entity_id")).agg(F.min("l_linenumber").alias("line"))
    level = F.when(F.col("line") == 1, "PRIMARY").when(F.col("line") <= 3, "SECONDARY").otherwise("MENTIONED")
    return lines.select("article_id", "entity_id", level.alias("importance"))


ARTICLE_ENTITIES_SQL = """article_entity AS (SELECT l_orderkey AS article_id, l_suppkey AS entity_id,
  CASE WHEN min(l_linenumber) = 1 THEN 'PRIMARY' WHEN min(l_linenumber) <= 3 THEN 'SECONDARY' ELSE 'MENTIONED' END AS importance
  FROM lineitem GROUP BY l_orderkey, l_suppkey)"""


def primary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item, entity``: the primary and secondary entities of every article, for clustering."""
    return article_entities(spark, sf_dir).where("importance <> 'MENTIONED'").select(F.col("article_id").alias("item"), F.col("entity_id").alias("entity"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name, type`` from parts, six part types mapped onto entity types."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.element_at(F.array(*map(F.lit, ENTITY_TYPES)), (F.col("p_size") % 4 + 1).cast("int")).alias("type"))


ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "PRODUCT")


TOPICS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "Alert: Near", "5-LOW")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``device_id, topic, priority``: every customer subscribes to one topic, one in five to alerts."""
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    level = F.when(F.col("c_mktsegment") == "BUILDING", "high").when(F.col("c_mktsegment") == "MACHINERY", "low")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), topic.alias("topic"), level.alias("priority"))


DEVICES_SQL = """device AS (SELECT c_custkey AS device_id, (['1-URGENT', '2-HIGH', '3-MEDIUM', 'Alert: Near', '5-LOW'])[c_custkey % 5 + 1] AS topic,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'high' WHEN 'MACHINERY' THEN 'low' END AS priority FROM customer)"""


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, continent, country, region, person`` of every customer."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
        .select(F.col("c_custkey").alias("id"), F.col("r_name").alias("continent"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("region"), F.col("c_name").alias("person"))
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``continent, country, region, city, person`` from customers and their nations."""
    city = F.concat(F.lit("city-"), (F.col("id") % 7).cast("string"))
    return homes(spark, sf_dir).select("continent", "country", "region", city.alias("city"), "person")


PLACES_SQL = """place AS (SELECT r_name AS continent, n_name AS country, c_mktsegment AS region, 'city-' || (c_custkey % 7)::VARCHAR AS city, c_name AS person
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``article_id, cluster_id, similarity``: orders of one customer form a story."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("cluster_id"), (F.col("o_orderkey") % 97 / 97.0).alias("similarity"))


STORIES_SQL = "story AS (SELECT o_orderkey AS article_id, o_custkey AS cluster_id, (o_orderkey % 97) / 97.0::DOUBLE AS similarity FROM orders)"

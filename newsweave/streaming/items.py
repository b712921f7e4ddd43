"""The item pipeline to its end: queue rows to records, entities, links, aliases, clusters, similar articles and documents.

All tables of a batch are committed together (``plans.tables``): a batch that fails between two of them leaves none of its rows
behind, and a batch that is repeated after its commit changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsweave.functions import names as N
from newsweave.operators import aliases as AL
from newsweave.operators import delivery as DL
from newsweave.operators import incremental as IN
from newsweave.operators import matching as MA
from newsweave.operators import routing as RO
from newsweave.operators import similarity as SI
from newsweave.plans.durable import durable
from newsweave.plans.tables import Batch, Tables

ITEMS = (
    "id BIGINT, normalized_url STRING, hash STRING, title_domain_hash STRING, topic STRING, kind STRING, text STRING, pub_date TIMESTAMP_NTZ, event_date STRING, alert STRING, relation STRING, "
    "answers ARRAY<STRUCT<question: STRING, response: STRING>>, entities ARRAY<STRUCT<name: STRING, type: STRING, importance: STRING>>, embedding ARRAY<FLOAT>"
)


def item_tables(spark: SparkSession, root: str, buckets: int = IN.BUCKETS) -> Tables:
    """The tables that ``process_batch`` writes."""
    layouts = {
        "records": (("normalized_url",), buckets),
        "text_keys": (("hash",), buckets),
        "title_keys": (("title_domain_hash",), buckets),
        "entities": (("normalized_name", "type"), buckets),
        "links": (("article_id", "normalized_name", "type"), buckets, ("article_id",)),
        "aliases": (("canonical", "alias", "type"), buckets),
        "vectors": (("id",), buckets),
        "similar": (("source_id", "target_id"), buckets, ("source_id",)),
        "documents": (("id",), buckets),
    }
    return Tables(spark, root, layouts | IN.cluster_tables(spark, root, buckets).layouts)


def _fresh(batch: Batch, items: DataFrame) -> DataFrame:
    """Items whose text and title no record has, the first of each text and of each title of the batch; reads the buckets of their keys only."""
    for table, key in (("text_keys", "hash"), ("title_keys", "title_domain_hash")):
        if batch.has(table):
            known = batch.read(table, batch.tables.buckets_of(table, items))
            items = items.join(known.select(key).distinct(), key, "left_anti")
        nth = F.row_number().over(Window.partitionBy(F.coalesce(key, F.concat(F.lit("\x00"), F.col("id").cast("string")))).orderBy("id"))
        items = durable(items.withColumn("nth", nth).where("nth = 1").drop("nth"), "fresh")
    return items


def process_batch(
    batch: Batch, items: DataFrame, as_of: str, negatives: DataFrame | None = None,
    k: int = 10, vector_threshold: float = 0.80, threshold: float = 0.70, days: int = 14, window: tuple[int, int] = (14, 1),
) -> None:
    """One batch of verdict-queue rows (``ITEMS``) through all steps, in the order of a single item's.

    Known texts and titles go; answers become the record, and decide with the alert what is relevant; relevant items get their
    entities (in normal forms) and links; alias phrases of their texts become proposals; their primary entities
    assign a cluster; similar articles are searched by vector and by shared entities, names matched fuzzily; record, cluster
    and similar articles become the document. Rows that are not relevant keep their record only.
    """
    stamp = F.lit(batch.batch_id).cast("long").alias("at")
    items = _fresh(batch, items)
    alerts = items.where("alert IS NOT NULL").select(F.col("id").alias("article_id"), F.col("alert").alias("topic"), "relation")
    verdicts = items.select(F.col("id").alias("article_id"), F.explode("answers").alias("a")).select("article_id", "a.question", "a.response")
    none = items.select("hash", "title_domain_hash").limit(0)
    decided = RO.processed_items(items.select("id", "normalized_url", "hash", "title_domain_hash", "topic", "pub_date", "kind"), none, verdicts, alerts)
    decided = durable(decided.join(items.select("id", "event_date"), "id"), "decided")
    kept = items.join(decided.where("is_relevant").select("id"), "id", "left_semi")

    named = kept.select(F.col("id").alias("article_id"), F.explode("entities").alias("e")).select("article_id", "e.name", "e.type", "e.importance").where("name IS NOT NULL AND type IS NOT NULL")
    named = named.withColumn("normalized_name", N.normalize_name("name", "type")).where("normalized_name <> ''")
    links = durable(named.groupBy("article_id", "normalized_name", "type").agg(F.min_by("importance", -MA.weight(F.col("importance"))).alias("importance"), F.min("name").alias("name")), "links")
    batch.upsert("entities", links.groupBy("normalized_name", "type").agg(F.min("name").alias("name")).withColumn("at", stamp), "at")
    batch.upsert("links", links.select("article_id", "normalized_name", "type", "importance", stamp), "at")

    proposed = AL.alias_pairs(kept.select("id", "text")).where("canonical IS NOT NULL")
    proposed = proposed.withColumns({"canonical": N.normalize_name("canonical", "type"), "alias": N.normalize_name("alias", "type")})
    proposed = proposed.groupBy("canonical", "alias", "type").agg(F.max("confidence").alias("confidence"))
    proposed = durable(proposed.withColumns({"source": F.lit("pattern"), "status": F.lit("PENDING"), "approved_by": F.lit(None).cast("string")}), "proposed")
    barred = negatives if negatives is not None else proposed.select(F.lit("").alias("name_lo"), F.lit("").alias("name_hi"), "type").limit(0)
    batch.replace("aliases", proposed, lambda old: AL.upsert_aliases(proposed.limit(0) if old is None else old, proposed, barred))

    primary = links.where("importance = 'PRIMARY'").select(F.col("article_id").alias("item"), F.concat_ws(":", "type", "normalized_name").alias("entity"))
    clusters = IN.assign_batch(batch, primary).select(F.col("item").alias("id"), "cluster_id")
    records = durable(decided.join(clusters, "id", "left").withColumn("at", stamp), "records")
    batch.upsert("records", records, "at")
    batch.append("text_keys", records.select("hash").where("hash IS NOT NULL").distinct())
    batch.append("title_keys", records.select("title_domain_hash").where("title_domain_hash IS NOT NULL").distinct())
    fresh_vectors = kept.where("embedding IS NOT NULL").select("id", "embedding", F.col("pub_date").alias("published"), stamp)
    batch.upsert("vectors", durable(fresh_vectors, "vectors"), "at")

    similar = durable(_similar(batch, records.where("is_relevant").select(F.col("id").alias("article_id")), as_of, k, vector_threshold, threshold, days, window), "similar")
    batch.upsert("similar", similar.withColumn("at", stamp), "at")
    matches = similar.where("status = 'match'").select("source_id", "target_id", "score")
    relevant = records.where("is_relevant").select("id", "normalized_url", "category", "tiny_summary", "analysis", "cluster_id")
    batch.upsert("documents", DL.article_documents(relevant, matches).withColumn("at", stamp), "at")


def _similar(batch: Batch, sources: DataFrame, as_of: str, k: int, vector_threshold: float, threshold: float, days: int, window: tuple[int, int]) -> DataFrame:
    """Similar articles of ``sources`` among all records so far; approved aliases name one entity, other names match fuzzily."""
    aliases = batch.read("aliases")
    names = batch.read("entities").select(F.col("normalized_name").alias("name"), "type")
    named = AL.canonical_names(names, aliases)
    ids = durable(named.select(F.col("name").alias("normalized_name"), "type", "canonical", F.xxhash64("canonical", "type").alias("entity_id")), "entity-ids")
    links = durable(batch.read("links").join(ids, ["normalized_name", "type"]).groupBy("article_id", "entity_id").agg(F.min_by("importance", -MA.weight(F.col("importance"))).alias("importance")), "entity-links")
    known = durable(ids.groupBy("entity_id", "type").agg(F.min("canonical").alias("name")).select("entity_id", "name", "type"), "entity-names")
    mine = known.join(links.join(sources, "article_id").select("entity_id").distinct(), "entity_id", "left_semi").select("name", "type")
    matches = durable(MA.name_matches(mine, known.select("name", "type")), "name-matches")
    articles = batch.read("records").where("is_relevant").select("id", "pub_date", "event_date")
    vectors = batch.read("vectors").select("id", "embedding", "published")
    return SI.combined_search(vectors, articles, links, known, matches, sources, as_of, k, vector_threshold, threshold, days, window)


def item_stream(spark: SparkSession, queue: str, tables: Tables, as_of: str, checkpoint: str, every: str | None = None, files: int | None = None, job: str = "items") -> StreamingQuery:
    """The verdict queue at ``queue`` (Parquet, ``ITEMS``) through ``process_batch``, a batch of at most ``files`` files at a time."""
    reader = spark.readStream.schema(ITEMS)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(queue)
    writer = rows.writeStream.foreachBatch(item_body(tables, as_of, job)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def item_body(tables: Tables, as_of: str, job: str = "items") -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body of ``item_stream``."""

    def body(rows: DataFrame, batch_id: int) -> None:
        with tables.batch(job, batch_id) as batch:
            if not batch.skipped:
                process_batch(batch, durable(rows, "items"), as_of)

    return body

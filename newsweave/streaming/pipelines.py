"""Structured Streaming forms: scheduled ingestion, idempotent inserts, late data, hand-offs, counters, cluster assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsweave.functions import text as T
from newsweave.operators.dedup import next_in_queue
from newsweave.plans.durable import durable
from newsweave.plans.tables import Tables
from newsweave.sources import feeds as FE

PAYLOADS = "feed_url STRING, content_type STRING, content_encoding STRING, body BINARY, fetched_at TIMESTAMP"


def fresh_entries(entries: DataFrame, articles: DataFrame, watermark: str = "8 days") -> DataFrame:
    """Stream of entries that are new by URL key: duplicates within the watermark and known articles go."""
    keyed = entries.withColumn("normalized_url", T.url_key(F.col("url"))).where("normalized_url IS NOT NULL")
    once = keyed.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["normalized_url"])
    return once.join(articles.select("normalized_url").distinct(), "normalized_url", "left_anti")


def route_late(days: int, queue: Callable[[DataFrame], None], stale: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body: old entries are handed on as stale instead of being dropped by a watermark."""

    def body(batch: DataFrame, batch_id: int) -> None:
        old = F.coalesce(F.col("pub_date") < F.col("seen_at") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
        batch = batch.persist()
        try:
            queue(batch.where(~old))
            stale(batch.where(old))
        finally:
            batch.unpersist()

    return body


def address_counters(events: DataFrame) -> DataFrame:
    """First and last time per device and address; works on streams (update mode) and tables."""
    return events.groupBy("device_id", "ip_address").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("events"))


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, watermark: str | None = "1 day") -> DataFrame:
    """Events and value per event-time window and type: tumbling, or sliding with ``slide``."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming and watermark else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = "1 day") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming and watermark else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def assign_from_index(tables: Tables, job: str = "clusters", threshold: float = 0.60, newest_first: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that assigns each batch of ``item, entity`` rows against the index of all former leaders.

    Leaders, keys and assignments are committed together; a batch that is repeated after its commit does nothing.
    """
    from newsweave.operators.incremental import assign_batch

    def body(rows: DataFrame, batch_id: int) -> None:
        with tables.batch(job, batch_id) as batch:
            if not batch.skipped:
                assign_batch(batch, rows, threshold, newest_first)

    return body


def assign_batches(read_leaders: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], threshold: float = 0.60) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that assigns each batch of ``item, entity`` rows against clusters that are kept elsewhere; it keys all of them each time."""
    from newsweave.operators.clusters import leader_clusters

    def body(batch: DataFrame, batch_id: int) -> None:
        write(leader_clusters(batch, threshold, read_leaders()), batch_id)

    return body


def feed_entries(payloads: DataFrame) -> DataFrame:
    """``normalized_url, url, title, published, feed_url`` of landed payloads, each URL once."""
    decoded = FE.decoded_payloads(payloads)
    json_like = F.coalesce(F.ltrim("text").startswith("{") | F.ltrim("text").startswith("["), F.lit(False))
    entries = FE.json_entries(decoded.where(json_like)).unionByName(FE.xml_entries(decoded.where(~json_like)))
    keyed = entries.withColumn("normalized_url", T.url_key(F.col("url"))).where("normalized_url IS NOT NULL")
    return keyed.groupBy("normalized_url").agg(F.min(F.struct("url", "title", "published", "feed_url")).alias("e")).select("normalized_url", "e.*")


def ingest_feeds(spark: SparkSession, landed: str, queue: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Landed payload files (Parquet, ``PAYLOADS``) to queue rows, each URL once.

    Runs through what has landed and stops, or with ``every`` (``"10 minutes"``) again and again. A batch is written
    under its number, so that a repeated batch replaces its own rows. The queue only grows; ``ingest_queue`` keeps one that is
    cleaned and taken from.
    """
    payloads = spark.readStream.schema(PAYLOADS).parquet(landed)

    def body(batch: DataFrame, batch_id: int) -> None:
        table_append(queue, ["normalized_url"])(feed_entries(batch), batch_id)

    writer = payloads.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def queue_tables(spark: SparkSession, root: str, buckets: int = 16) -> Tables:
    """A queue (``queue``) and the keys of all URLs ever queued (``queued``), both by URL key."""
    return Tables(spark, root, {"queue": (("normalized_url",), buckets), "queued": (("normalized_url",), buckets)})


def ingest_queue(tables: Tables, landed: str, checkpoint: str, articles: Callable[[], DataFrame] | None = None, every: str | None = None, files: int | None = None, job: str = "feeds") -> StreamingQuery:
    """As ``ingest_feeds``, into a queue table: each batch first takes rows that are articles by now out of the queue, then adds
    entries that are neither articles nor were ever queued. ``articles`` gives the present article table (``normalized_url``).

    A batch looks into the buckets of its own URLs; files are rewritten as they become many (``plans.tables``).
    """
    reader = tables.spark.readStream.schema(PAYLOADS)
    payloads = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(landed)

    def body(rows: DataFrame, batch_id: int) -> None:
        with tables.batch(job, batch_id) as batch:
            if batch.skipped:
                return
            fresh = durable(feed_entries(rows), "entries")
            known = articles().select("normalized_url").where("normalized_url IS NOT NULL").distinct() if articles else None
            if known is not None:
                if batch.has("queue"):
                    batch.remove("queue", durable(batch.read("queue").select("normalized_url").join(known, "normalized_url", "left_semi"), "done"))
                fresh = fresh.join(known, "normalized_url", "left_anti")
            if batch.has("queued"):
                fresh = fresh.join(batch.read("queued", tables.buckets_of("queued", fresh)), "normalized_url", "left_anti")
            fresh = durable(fresh.withColumn("seen_at", F.lit(batch_id).cast("long")), "fresh")
            batch.append("queue", fresh)
            batch.append("queued", fresh.select("normalized_url"))

    writer = payloads.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def take_from_queue(tables: Tables, n: int, turn: int, order: str = "oldest", job: str = "taker") -> DataFrame:
    """The next ``n`` queue rows, taken out of the queue in the same commit; a repeated ``turn`` takes nothing more."""
    with tables.batch(job, turn) as batch:
        queue = batch.read("queue")
        first = durable(next_in_queue(queue, 0 if batch.skipped else n, order), "taken")
        batch.remove("queue", first)
    return first


def keep_counters(tables: Tables, name: str, count: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], job: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that keeps a table of counters right: ``count`` sums up a batch, ``merge`` puts rows of one key together.

    Only the buckets of the batch's keys are rewritten. Nothing depends on the order of rows, so late ones count like others; a
    batch that is repeated after its commit does not count twice.
    """

    def body(rows: DataFrame, batch_id: int) -> None:
        with tables.batch(job, batch_id) as batch:
            if not batch.skipped:
                fresh = durable(count(rows), name)
                batch.replace(name, fresh, lambda old: fresh if old is None else merge(old.unionByName(fresh)))

    return body


def merged_addresses(rows: DataFrame) -> DataFrame:
    """Rows of ``address_counters`` put together by device and address."""
    return rows.groupBy("device_id", "ip_address").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))


def table_append(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that appends rows whose ``key`` is new to the table at ``path``, one folder a batch."""

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folders = [f for f in _batches(spark, path) if f != f"batch={batch_id}"]
        if folders:
            known = spark.read.schema(batch.schema).parquet(*[f"{path}/{f}" for f in folders]).select(*key).distinct()
            batch = batch.join(known, key, "left_anti")
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return body


def _batches(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(place) if f.getPath().getName().startswith("batch=")) if store.exists(place) else []


def hand_off(spark: SparkSession, queue: str, schema: str, decide: Callable[[DataFrame], DataFrame], routes: dict[str, str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One queue's rows to the next queues: ``decide`` adds a ``route`` to each row, ``routes`` names a table for each.

    Chained calls make the pipeline: the table one writes is the queue the next one reads. The checkpoint remembers
    what was taken, which stands for deleting rows from the queue.
    """
    rows = spark.readStream.schema(schema).parquet(f"{queue}/batch=*")

    def body(batch: DataFrame, batch_id: int) -> None:
        routed = decide(batch).persist()
        try:
            for route, path in routes.items():
                routed.where(F.col("route") == route).drop("route").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            routed.unpersist()

    writer = rows.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def decision_counters(decisions: DataFrame) -> DataFrame:
    """Suggestions, approvals and rejections by source; works on streams (update mode) and tables."""
    return decisions.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "APPROVE").alias("approved"), F.count_if(F.col("decision") == "REJECT").alias("rejected"))


def rejection_counters(decisions: DataFrame) -> DataFrame:
    """How often each unordered pair was rejected for being different entities; works on streams (update mode) and tables."""
    rejected = decisions.where("decision = 'REJECT' AND reason = 'different entity'")
    return rejected.groupBy(F.least("canonical", "alias").alias("name_lo"), F.greatest("canonical", "alias").alias("name_hi"), "type").agg(F.count("*").alias("persistence_level"))


def versioned(before: DataFrame | None, now: DataFrame, key: str = "cluster_id") -> DataFrame:
    """A snapshot with a ``version`` for each row: 1 when it is new, one more whenever any other column changed."""
    state = [c for c in now.columns if c != key]
    stamped = now.withColumn("stamp", F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in state]))
    if before is None:
        return stamped.withColumn("version", F.lit(1).cast("long"))
    old = before.select(key, F.col("stamp").alias("old_stamp"), F.col("version").alias("old_version"))
    joined = stamped.join(old, key, "left")
    version = F.when(F.col("old_version").isNull(), 1).when(F.col("stamp") == F.col("old_stamp"), F.col("old_version")).otherwise(F.col("old_version") + 1)
    return joined.select(key, *state, "stamp", version.cast("long").alias("version"))

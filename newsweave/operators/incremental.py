"""Cluster assignment and merging batch by batch, against an index of all former sets that is kept in tables.

``leader_keys`` is an inverted index: the keys of every leader's set, in buckets by key. A batch computes its own keys, reads
the buckets they fall into, confirms the candidates on their sets and adds the keys of its new leaders; former
leaders are never keyed again. The order of elements that the keys need is that of the first batch (elements seen
later count as rarest): any fixed order gives the same pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.operators import clusters as CL
from newsweave.operators.setjoin import MAX_BROADCAST_CLASSES, class_pairs, confirmed, element_counts, join_keys, keys_meet, set_classes
from newsweave.plans.durable import broadcast_if_small, durable
from newsweave.plans.graph import connected_components
from newsweave.plans.tables import Batch, Tables

BUCKETS = 16


def _layouts(buckets: int) -> dict[str, tuple]:
    return {"sets": (("rep",), buckets), "set_keys": (("key",), buckets), "element_order": (("entity",), max(1, buckets // 8))}


def cluster_tables(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Tables:
    """Tables for ``assign_batch``: leaders' sets and keys, and assignments."""
    return Tables(spark, root, _layouts(buckets) | {"assignments": (("item",), buckets)})


def merge_tables(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Tables:
    """Tables for ``merge_batch``: classes of equal cluster sets with their keys and days, and groups."""
    return Tables(spark, root, _layouts(buckets) | {"days": (("class", "day"), buckets, ("class",)), "groups": (("cluster_id",), buckets)})


def _order(batch: Batch, classes: DataFrame) -> DataFrame:
    """The fixed order of elements, from the first batch."""
    if not batch.has("element_order"):
        batch.append("element_order", element_counts(classes))
    return batch.read("element_order")


def probe(batch: Batch, classes: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity``: sets of the batch (``rep, set, n`` with their ``keys``) and similar or equal indexed sets; reads probed buckets only."""
    if not batch.has("set_keys"):
        like = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        return like.limit(0).withColumn("similarity", F.lit(0.0))
    tables = batch.tables
    index = batch.read("set_keys", tables.buckets_of("set_keys", keys))
    mine = broadcast_if_small(keys, MAX_BROADCAST_CLASSES).alias("x")
    met = index.alias("y").join(mine, keys_meet("x", "y", threshold)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    met = durable(met.distinct(), "met")
    others = batch.read("sets", tables.buckets_of("sets", met.select(F.col("b").alias("rep"))))
    return confirmed(met, classes, others, threshold)


def assign_batch(batch: Batch, sets: DataFrame, threshold: float = 0.60, newest_first: bool = False, at_most: int | None = None) -> DataFrame:
    """Assign the items of ``sets`` (``item, entity``) and keep leaders, keys and assignments; returns ``item, cluster_id, similarity``.

    As ``clusters.leader_clusters`` with the leaders of all former batches in the order of their batches. Items that have an
    assignment already are left out, so a batch may hold old articles.
    """
    if batch.has("assignments"):
        items = durable(sets.select("item").where("item IS NOT NULL").distinct(), "items")
        old = batch.read("assignments", batch.tables.buckets_of("assignments", items)).select("item")
        sets = sets.join(old.join(broadcast_if_small(items, CL.MAX_BROADCAST_ITEMS), "item", "left_semi"), "item", "left_anti")
    if at_most is not None:
        sets = CL.first_items(sets, at_most, newest_first)
    sign = -1 if newest_first else 1
    classes, members = set_classes(sets.select((F.col("item") * sign).alias("id"), "entity"))
    keys = durable(join_keys(classes, _order(batch, classes), threshold, equal=True), "keys")
    found = durable(probe(batch, classes, keys, threshold), "found")
    if batch.has("sets"):
        born = batch.read("sets", batch.tables.buckets_of("sets", found.select(F.col("b").alias("rep")))).select(F.col("rep").alias("b"), "batch", "place")
        found = found.join(born, "b")
    else:
        found = found.withColumns({"batch": F.lit(0).cast("long"), "place": F.lit(0).cast("long")})
    old = durable(CL.nearest(found, "batch", "place").select("rep", "b", "similarity"), "old")
    assigned = CL.assigned_classes(classes, members, old.select("rep", F.lit(None).cast("long").alias("cluster_id"), "similarity"), threshold)
    assigned = durable(assigned.withColumnRenamed("cluster_id", "new_id"), "assigned")
    named = assigned.join(members, assigned.item == members.id).join(old.select("rep", "b"), "rep", "left")
    result = durable(named.select((F.col("item") * sign).alias("item"), F.coalesce(F.col("new_id") * sign, "b").alias("cluster_id"), "similarity"), "result")
    fresh = assigned.where("item = new_id").select(F.col("item").alias("rep"))
    new = durable(classes.join(fresh, "rep", "left_semi"), "leaders")
    batch.append("sets", new.select((F.col("rep") * sign).alias("rep"), "set", "n", F.lit(batch.batch_id).cast("long").alias("batch"), F.col("rep").alias("place")))
    batch.append("set_keys", keys.join(new.select("rep"), "rep", "left_semi").withColumn("rep", F.col("rep") * sign))
    batch.append("assignments", result)
    return result


def merge_batch(batch: Batch, changed: DataFrame, ratio: float = 0.60, latest: DataFrame | None = None, days: int = 14) -> DataFrame:
    """Take clusters (``cluster_id, entity``, whole sets) in and return the members of all groups that they belong to now: ``cluster_id, group_id``.

    Two clusters belong together if their sets reach ``ratio`` and, with ``latest`` (``cluster_id, latest`` of the changed clusters),
    both were last active within ``days`` days; clusters without a date stay alone then. Only the changed sets are compared, with the
    index and with each other. Equal sets are one class with one node for each day on which a cluster of it was last
    active, so a changed cluster meets at most ``2 * days + 1`` nodes of a similar class however many clusters that has. The links
    hook groups together: components are computed over the groups at their ends, and rows of ``groups`` are rewritten only
    if their group changed. A group's id is its smallest cluster.

    A cluster's set must not change (assignment never changes it, a merge makes a new cluster); a cluster that is given again
    with a later date is linked by that date too. Groups that were joined stay joined.
    """
    tables = batch.tables
    dated = changed.select("cluster_id").distinct()
    dated = dated.join(latest.groupBy("cluster_id").agg(F.max(F.col("latest").cast("date")).alias("day")), "cluster_id", "left") if latest is not None else dated.withColumn("day", F.lit("2000-01-01").cast("date"))
    classes, members = set_classes(changed.select(F.col("cluster_id").alias("id"), "entity"))
    keys = durable(join_keys(classes, _order(batch, classes), ratio, equal=True), "keys")
    found = durable(probe(batch, classes, keys, ratio), "found")
    same = durable(found.where("similarity = 1").select(F.col("a").alias("rep"), F.col("b").alias("known")), "same")
    names = durable(classes.select("rep").join(same, "rep", "left").select("rep", F.coalesce("known", "rep").alias("class")), "names")
    new = durable(classes.join(same, "rep", "left_anti"), "new")
    batch.append("sets", new.select("rep", "set", "n", F.lit(batch.batch_id).cast("long").alias("batch"), F.col("rep").alias("place")))
    batch.append("set_keys", keys.join(new.select("rep"), "rep", "left_semi"))

    mine = durable(dated.join(members, dated.cluster_id == members.id).join(names, "rep").select("cluster_id", "class", "day"), "mine")
    nodes = mine.where("day IS NOT NULL").groupBy("class", "day").agg(F.min("cluster_id").alias("cluster_id"))
    batch.upsert("days", nodes.withColumn("at", F.lit(-batch.batch_id).cast("long")), "at")  # the first cluster of a day stays its node
    near = class_pairs(classes, ratio).select("a", "b")
    named = lambda s: names.select(F.col("rep").alias(s), F.col("class").alias(f"class_{s}"))
    inside = near.join(named("a"), "a").join(named("b"), "b")
    pairs = found.where("similarity < 1").join(named("a"), "a").select("class_a", F.col("b").alias("class_b"))
    pairs = pairs.unionByName(inside.select("class_a", "class_b")).unionByName(inside.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    pairs = durable(pairs.unionByName(names.select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))).distinct(), "pairs")
    stretch = lambda day: F.floor(F.unix_date(day) / max(days, 1)).cast("int")
    others = batch.read("days", tables.buckets_of("days", pairs.select(F.col("class_b").alias("class"))))
    others = others.select(F.col("class").alias("class_b"), F.col("day").alias("other_day"), F.col("cluster_id").alias("other"), stretch(F.col("day")).alias("stretch"))
    asked = mine.where("day IS NOT NULL").groupBy("class", "day").agg(F.min("cluster_id").alias("cluster_id"))
    asked = asked.join(pairs, asked["class"] == pairs.class_a).withColumn("stretch", F.explode(F.array(*(stretch(F.col("day")) + k for k in (-1, 0, 1)))))
    met = asked.join(others, ["class_b", "stretch"]).where(F.abs(F.datediff("day", "other_day")) <= days)
    stars = mine.join(asked.select("class", "day", F.col("cluster_id").alias("first")).distinct(), ["class", "day"]).select(F.col("cluster_id").alias("a"), F.col("first").alias("b"))
    edges = durable(met.select(F.col("cluster_id").alias("a"), F.col("other").alias("b")).unionByName(stars).where("a <> b").distinct(), "edges")

    fresh = mine.select("cluster_id")
    if batch.has("groups"):
        fresh = fresh.join(batch.read("groups", tables.buckets_of("groups", fresh)).select("cluster_id"), "cluster_id", "left_anti")
    batch.append("groups", durable(fresh.withColumn("group_id", F.col("cluster_id")), "fresh"))
    labels = batch.read("groups")
    label = lambda s: labels.select(F.col("cluster_id").alias(s), F.col("group_id").alias(f"group_{s}"))
    hooks = edges.join(label("a"), "a").join(label("b"), "b").where("group_a <> group_b").select("group_a", "group_b")
    joined = connected_components(hooks, "group_a", "group_b").select(F.col("node").alias("group_id"), F.col("label").alias("joined"))
    moved = broadcast_if_small(durable(joined.where("group_id <> joined"), "moved"), MAX_BROADCAST_CLASSES)
    relabelled = durable(labels.join(moved, "group_id").select("cluster_id", F.col("joined").alias("group_id")), "relabelled")
    batch.replace("groups", relabelled, lambda old: relabelled)
    after = batch.read("groups")
    touched = broadcast_if_small(durable(after.join(mine.select("cluster_id"), "cluster_id", "left_semi").select("group_id").distinct(), "touched"), MAX_BROADCAST_CLASSES)
    return durable(after.join(touched, "group_id", "left_semi").select("cluster_id", "group_id"), "groups")

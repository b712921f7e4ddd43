"""Story clusters: order-faithful leader clustering, records, merges, lineage, significance, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.operators.setjoin import class_pairs, cross_pairs, jaccard_pairs, set_classes
from newsweave.plans.durable import broadcast_if_small, durable
from newsweave.plans.graph import connected_components
MAX_BROADCAST_ITEMS = 500_000


def _elected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The leaders among ``nodes`` (``id``): ids without an earlier neighbour (``id, before``) that leads.

    Each round makes leaders of all nodes without earlier open neighbours, takes their neighbours out, and keeps
    open nodes and the edges between them only, so rounds shrink; their number is logarithmic with high probability.
    """
    done = []
    while nodes.limit(1).count():
        waiting = edges.select("id").distinct()
        leaders = durable(nodes.join(waiting, "id", "left_anti"), "leaders")
        done.append(leaders)
        led = edges.join(leaders.select(F.col("id").alias("before")), "before").select("id").distinct()
        rest = durable(waiting.join(led, "id", "left_anti"), "open", replaces=nodes)
        nodes = rest
        edges = durable(edges.join(rest, "id", "left_semi").join(rest.select(F.col("id").alias("before")), "before", "left_semi").select("id", "before"), "open-edges", replaces=edges)
    elected = done[0] if done else nodes
    for more in done[1:]:
        elected = elected.unionByName(more)
    return elected


def first_items(sets: DataFrame, n: int, newest_first: bool = True) -> DataFrame:
    """The rows of the ``n`` first items of ``sets`` (``item, entity``), by descending or ascending item."""
    chosen = durable(sets.select("item").where("item IS NOT NULL").distinct().orderBy(F.desc("item") if newest_first else F.asc("item")).limit(n), "first")
    return sets.join(broadcast_if_small(chosen, MAX_BROADCAST_ITEMS), "item", "left_semi")


def leader_clusters(sets: DataFrame, threshold: float = 0.60, leaders: DataFrame | None = None, newest_first: bool = False, at_most: int | None = None) -> DataFrame:
    """``item, cluster_id, similarity``: the assignment a sequential loop over the items would make.

    ``sets`` has ``item, entity`` rows, processed by ascending item, or descending with ``newest_first``; only the first ``at_most``
    items if that is given. An item joins the leader of highest Jaccard among those before it (ties: the one met
    first) if it reaches ``threshold``, else it becomes a leader whose id names the cluster. Existing ``leaders``
    (``item, entity`` with their cluster ids as items) come before all others, in the same order among themselves.
    """
    if at_most is not None:
        sets = first_items(sets, at_most, newest_first)
    turned = (lambda df: df.withColumn("item", -F.col("item"))) if newest_first else (lambda df: df)
    classes, members = set_classes(turned(sets).select(F.col("item").alias("id"), "entity"))
    old = None
    if leaders is not None:
        known, _ = set_classes(turned(leaders).select(F.col("item").alias("id"), "entity"))
        old = nearest(cross_pairs(classes, known, threshold), "b").select("rep", F.col("b").alias("cluster_id"), "similarity")
    assigned = assigned_classes(classes, members, old, threshold)
    if newest_first:
        assigned = assigned.select((-F.col("item")).alias("item"), (-F.col("cluster_id")).alias("cluster_id"), "similarity")
    return assigned


def nearest(pairs: DataFrame, *ties: str) -> DataFrame:
    """For each ``a`` of ``pairs`` (as ``rep``) its row of highest similarity, ties by the columns named."""
    others = [c for c in pairs.columns if c != "a"]
    best = F.min_by(F.struct(*others), F.struct((-F.col("similarity")).alias("s"), *ties))
    return pairs.groupBy(F.col("a").alias("rep")).agg(best.alias("r")).select("rep", "r.*")


def assigned_classes(classes: DataFrame, members: DataFrame, old: DataFrame | None, threshold: float) -> DataFrame:
    """``item, cluster_id, similarity`` for all ``members`` of ``classes``; ``old`` has the best existing cluster of a class (``rep, cluster_id, similarity``).

    Equal sets collapse to their first item for the election of leaders. A later equal item may still find a
    better leader, so each set keeps the leaders that beat all smaller ones, few for each set, and an item takes
    the last of them before it.
    """
    near = durable(class_pairs(classes, threshold), "near")
    nodes = classes.select(F.col("rep").alias("id"))
    if old is not None:
        old = durable(old.withColumn("kind", F.lit(0)), "old")
        nodes = nodes.join(old.select(F.col("rep").alias("id")), "id", "left_anti")
    nodes = durable(nodes, "nodes")
    edges = near.select(F.col("b").alias("id"), F.col("a").alias("before"))
    edges = edges.join(nodes, "id", "left_semi").join(nodes.select(F.col("id").alias("before")), "before", "left_semi").select("id", "before") if old is not None else edges
    elected = durable(_elected(nodes, durable(edges, "open-edges")), "elected")
    leading = elected.select(F.col("id").alias("cluster_id"))
    around = near.select(F.col("a").alias("rep"), F.col("b").alias("cluster_id"), "similarity").unionByName(near.select(F.col("b").alias("rep"), F.col("a").alias("cluster_id"), "similarity"))
    led = around.join(leading, "cluster_id").join(elected.select(F.col("id").alias("rep")), "rep", "left_anti").select("rep", "cluster_id", "similarity")
    before = Window.partitionBy("rep").orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    records = led.withColumn("most", F.max("similarity").over(before)).where("most IS NULL OR similarity > most").select("rep", "cluster_id", "similarity", F.lit(1).alias("kind"))
    if old is not None:
        records = records.unionByName(old)
    own = elected.select(F.col("id").alias("rep"), F.col("id").alias("cluster_id"), F.lit(1.0).alias("similarity"), F.lit(1).alias("kind"))
    options = members.join(records.unionByName(own), "rep").where("kind = 0 OR cluster_id <= id")
    choice = F.min_by(F.struct("cluster_id", "similarity"), F.struct((-F.col("similarity")).alias("s"), "kind", "cluster_id"))
    return options.groupBy(F.col("id").alias("item")).agg(choice.alias("c")).select("item", "c.cluster_id", "c.similarity")


def best_cluster(sets: DataFrame, clusters: DataFrame, threshold: float = 0.60) -> DataFrame:
    """``id, cluster_id, similarity``: each set's best cluster, the smaller id on ties."""
    pairs = jaccard_pairs(sets, clusters, threshold).withColumnsRenamed({"left_id": "a", "right_id": "cluster_id"})
    return nearest(pairs, "cluster_id").select(F.col("rep").alias("id"), "cluster_id", "similarity")


def merge_groups(cluster_sets: DataFrame, ratio: float = 0.60, latest: DataFrame | None = None, days: int = 14) -> DataFrame:
    """``cluster_id, group_id``: clusters (``id, entity``) connected by overlaps of at least ``ratio``; lone ones are left out.

    With ``latest`` (``cluster_id, latest``) only pairs that were last active within ``days`` days connect; clusters without a
    date stay alone. Clusters of equal sets form stretches of days without a longer gap. Two stretches hold a close pair exactly
    if they overlap or lie within ``days`` days, so stretches are linked, not clusters.
    """
    classes, members = set_classes(cluster_sets)
    near = class_pairs(classes, ratio)
    if latest is None:
        units = members.select("id", F.col("rep").alias("unit"))
        edges = near.select("a", "b")
    else:
        dates = latest.groupBy("cluster_id").agg(F.max(F.col("latest").cast("date")).alias("day"))
        dated = durable(members.join(dates, members.id == dates.cluster_id).where("day IS NOT NULL").select("id", "rep", "day"), "dated")
        nodes = dated.groupBy("rep", "day").agg(F.min("id").alias("first"))
        by_day = Window.partitionBy("rep").orderBy("day")  # one row a day at most
        begins = F.coalesce(F.datediff("day", F.lag("day").over(by_day)) > days, F.lit(True))
        stretches = nodes.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(by_day))
        stretches = durable(stretches.groupBy("rep", "part").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.min("first").alias("unit")), "stretches")
        side = lambda s: stretches.select(F.col("rep").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("lo", "hi", "unit")))
        apart = F.greatest(F.datediff("lo_b", "hi_a"), F.datediff("lo_a", "hi_b"))
        edges = near.join(side("a"), "a").join(side("b"), "b").where(apart <= days).select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"))
        units = dated.join(stretches, "rep").where("day BETWEEN lo AND hi").select("id", "unit")
    labels = connected_components(edges, "a", "b")
    named = durable(units.join(labels.withColumnRenamed("node", "unit"), "unit", "left").select(F.col("id").alias("cluster_id"), F.coalesce("label", "unit").alias("group_id")), "named")
    many = named.groupBy("group_id").count().where("count > 1").select("group_id")
    return named.join(many, "group_id").select("cluster_id", "group_id")


def close_in_time(pairs: DataFrame, latest: DataFrame, days: int) -> DataFrame:
    """Keeps cluster pairs ``a, b`` whose latest dates (``cluster_id, latest``) differ by at most ``days``."""
    side = lambda s: latest.select(F.col("cluster_id").alias(s), F.col("latest").alias(f"latest_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.abs(F.datediff("latest_a", "latest_b")) <= days).drop("latest_a", "latest_b")


def cluster_records(assignments: DataFrame, sets: DataFrame, times: DataFrame, summaries: DataFrame | None = None, merges: DataFrame | None = None) -> DataFrame:
    """One record per cluster, derived from its history instead of counters that are kept up to date.

    ``assignments``: ``cluster_id, article_id, similarity``; ``sets``: ``cluster_id, entity``; ``times``: ``article_id,
    added_at``; ``summaries``: ``cluster_id, written_at, summary`` for every summary written; ``merges``: ``source_id``.
    Columns: ``cluster_id, created_at, updated_at, primary_entity_ids, article_count, summary, summary_version,
    needs_summary_update, status``. A summary is due when an article came after the last one, or there is none.
    """
    articles = assignments.select("cluster_id", "article_id").distinct().join(times, "article_id").groupBy("cluster_id").agg(F.min("added_at").alias("created_at"), F.max("added_at").alias("updated_at"), F.count("*").alias("article_count"))
    entities = sets.groupBy("cluster_id").agg(F.array_sort(F.collect_set("entity")).alias("primary_entity_ids"))
    rows = entities.join(articles, "cluster_id", "full_outer")
    if summaries is not None:
        last = summaries.groupBy("cluster_id").agg(F.max_by("summary", "written_at").alias("summary"), F.max("written_at").alias("written_at"), F.count("*").alias("summary_version"))
        rows = rows.join(last, "cluster_id", "left")
    else:
        rows = rows.withColumns({"summary": F.lit(None).cast("string"), "written_at": F.lit(None).cast("timestamp_ntz"), "summary_version": F.lit(0).cast("long")})
    if merges is not None:
        rows = rows.join(merges.select(F.col("source_id").alias("cluster_id"), F.lit("merged").alias("merged")).distinct(), "cluster_id", "left")
    else:
        rows = rows.withColumn("merged", F.lit(None).cast("string"))
    due = F.col("written_at").isNull() | F.coalesce(F.col("updated_at") > F.col("written_at"), F.lit(False))
    return rows.select(
        "cluster_id", "created_at", "updated_at", F.coalesce("primary_entity_ids", F.array().cast(sets.select(F.array("entity")).schema[0].dataType)).alias("primary_entity_ids"), F.coalesce("article_count", F.lit(0)).alias("article_count"),
        "summary", F.coalesce("summary_version", F.lit(0)).alias("summary_version"), due.alias("needs_summary_update"), F.coalesce("merged", F.lit("active")).alias("status"),
    )


def merge_clusters(groups: DataFrame, mappings: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merge's new mappings, entity sets and lineage edges.

    ``groups``: ``cluster_id, group_id``; a group's new cluster takes the group id times -1 minus 1. An
    article of several sources keeps its highest score.
    """
    target = (-F.col("group_id") - 1).alias("target_id")
    edges = durable(groups.select(F.col("cluster_id").alias("source_id"), target), "merge")  # read by all results
    moved = mappings.join(edges, mappings.cluster_id == edges.source_id).groupBy(F.col("target_id").alias("cluster_id"), "article_id").agg(F.max("similarity").alias("similarity"))
    union = sets.join(edges, sets.cluster_id == edges.source_id).groupBy(F.col("target_id").alias("cluster_id")).agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return moved, union, edges


def merged_records(groups: DataFrame, mappings: DataFrame, sets: DataFrame, articles: DataFrame, as_of: str) -> DataFrame:
    """The clusters that a merge makes, whole: ``cluster_id, entities, sources, articles, quality, latest, significance``."""
    moved, union, edges = merge_clusters(groups, mappings, sets)
    summary = cluster_summary(durable(moved, "moved"), articles, as_of)
    return union.join(merge_sources(edges).withColumnRenamed("target_id", "cluster_id"), "cluster_id").join(summary, "cluster_id", "left")


def repointed(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """``articles`` with a ``cluster_id`` that was merged replaced by its final destination."""
    final = lineage(edges).select(F.col("source_id").alias("cluster_id"), "final_id").distinct()
    return articles.join(final, "cluster_id", "left").withColumn("cluster_id", F.coalesce("final_id", "cluster_id")).select(*articles.columns)


def check_and_merge(changed: DataFrame, cluster_sets: DataFrame, mappings: DataFrame, ratio: float = 0.60, latest: DataFrame | None = None, days: int = 14) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge after an assignment: groups that hold a cluster of ``changed`` (``cluster_id``), as ``merge_clusters`` gives them.

    With ``latest`` (``cluster_id, latest``) only pairs within ``days`` days connect. ``incremental.merge_batch`` keeps such groups from batch to batch.
    """
    groups = merge_groups(cluster_sets.select(F.col("cluster_id").alias("id"), "entity"), ratio, latest, days)
    touched = groups.join(changed.select("cluster_id").distinct(), "cluster_id", "left_semi").select("group_id").distinct()
    return merge_clusters(groups.join(touched, "group_id", "left_semi"), mappings, cluster_sets)


def merge_sources(edges: DataFrame) -> DataFrame:
    """``target_id, sources``: the clusters merged into each cluster, in order."""
    return edges.groupBy("target_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))


def cluster_entities(sets: DataFrame, entities: DataFrame) -> DataFrame:
    """``cluster_id, entity_id, name, type`` of the entities of each cluster that are known."""
    return sets.select("cluster_id", F.col("entity").alias("entity_id")).distinct().join(entities.select("entity_id", "name", "type"), "entity_id").select("cluster_id", "entity_id", "name", "type")


def cluster_report(clusters: DataFrame, sets: DataFrame, entities: DataFrame, mappings: DataFrame, articles: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Each cluster (``cluster_id, status``) with its destination, sources, entities and top articles as nested lists."""
    named = cluster_entities(sets, entities).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("type", "name", "entity_id"))).alias("entities"))
    shown = F.struct("rank", "article_id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce(F.date_format("pub_date", "yyyy-MM-dd"), F.lit("Unknown")).alias("date"))
    best = top_articles(mappings, articles, k).groupBy("cluster_id").agg(F.array_sort(F.collect_list(shown)).alias("articles"))
    into = edges.groupBy(F.col("source_id").alias("cluster_id")).agg(F.min("target_id").alias("merged_into"))
    sources = merge_sources(edges).select(F.col("target_id").alias("cluster_id"), F.col("sources").alias("merged_from"))
    rows = clusters.join(into, "cluster_id", "left").join(sources, "cluster_id", "left").join(named, "cluster_id", "left").join(best, "cluster_id", "left")
    return rows.select("cluster_id", "status", "merged_into", *[F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("merged_from", "entities", "articles")])


def existing_clusters(ids: DataFrame, clusters: DataFrame) -> DataFrame:
    """The ids (``cluster_id``) that name a cluster."""
    return ids.join(clusters.select("cluster_id"), "cluster_id", "left_semi")


def lineage(edges: DataFrame) -> DataFrame:
    """``source_id, target_id, final_id, hops``: one-hop and final destination by pointer jumping."""
    paths = durable(edges.select("source_id", F.col("target_id").alias("final_id"), F.lit(1).alias("hops")), "paths")
    while True:
        step = paths.select(F.col("source_id").alias("via"), F.col("final_id").alias("next_id"), F.col("hops").alias("more"))
        after = paths.join(step, paths.final_id == step.via, "left")
        moved = durable(after.select("source_id", F.coalesce("next_id", "final_id").alias("final_id"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next_id").isNotNull().alias("moved")), "paths")
        paths = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return edges.join(paths, "source_id").select("source_id", "target_id", "final_id", "hops")


def significance(count: Column, quality: Column, days: Column) -> Column:
    """``ln(1 + n) * (1 + q / 4) / (1 + days / 7)``."""
    return F.log1p(count) * (1 + quality / 4) / (1 + days / 7)


def cluster_summary(mappings: DataFrame, articles: DataFrame, as_of: str) -> DataFrame:
    """Per cluster its distinct articles, mean quality (0 without), latest date, and significance at ``as_of``."""
    rows = mappings.select("cluster_id", F.col("article_id").alias("id")).distinct().join(articles, "id")
    grouped = rows.groupBy("cluster_id").agg(F.count("*").alias("articles"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("quality"), F.max("pub_date").alias("latest"))
    days = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.col("latest").cast("date")))
    return grouped.withColumn("significance", significance(F.col("articles"), F.col("quality"), days))


def top_articles(mappings: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest articles of each cluster, then by similarity and id."""
    rows = mappings.join(articles.withColumnRenamed("id", "article_id"), "article_id")
    order = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("pub_date"), F.desc("similarity"), "article_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def summary_input(mappings: DataFrame, articles: DataFrame, k: int = 10) -> DataFrame:
    """``cluster_id, lines``: numbered article lines for a summary, each followed by the article's own summary if ``articles`` has one."""
    line = F.format_string("Article %d: [%s] %s", F.col("rank"), F.date_format("pub_date", "yyyy-MM-dd"), F.coalesce("title", F.lit("Untitled")))
    if "tiny_summary" in articles.columns:
        line = F.concat(line, F.lit("\n"), F.coalesce("tiny_summary", F.lit("")))
    top = top_articles(mappings, articles, k).withColumn("line", line)
    return top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def summary_entities(sets: DataFrame, entities: DataFrame, types: tuple[str, ...] = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT")) -> DataFrame:
    """``cluster_id`` and, for each type, the names of the cluster's entities in order."""
    rows = cluster_entities(sets, entities)
    lists = [F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("name")))).alias(kind.lower()) for kind in types]
    return rows.groupBy("cluster_id").agg(*lists)

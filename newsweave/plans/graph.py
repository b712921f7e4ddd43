"""Iterative graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.plans.durable import delete_folder, durable


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every vertex of ``edges`` with the smallest vertex id of its component.

    Returns ``(node, label)``. In each round a vertex takes the smallest label among its neighbours and hands it on
    to the vertex that its own label names, then every label jumps to that vertex's label. So whole trees are hooked
    at once and the number of rounds grows with the logarithm of the longest chain. Labels are written to the
    shared folder in each round; only whether some changed reaches the driver. Null ends and self loops are ignored,
    repeated edges change nothing.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    both = durable(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("best"))
        offers = durable(labels.join(near, "node").select("node", "label", F.least("label", "best").alias("best")), "offers")
        heard = offers.select("node", "best").unionByName(offers.select(F.col("label").alias("node"), "best")).groupBy("node").agg(F.min("best").alias("best"))
        hooked = durable(labels.join(heard, "node").select("node", F.least("label", "best").alias("label"), F.col("label").alias("was")), "hooked")
        roots = hooked.select(F.col("node").alias("root"), F.col("label").alias("up"))
        after = durable(hooked.join(roots, hooked.label == roots.root).select("node", F.least("label", "up").alias("label"), "was"), "labels", replaces=labels)
        for done in (offers, hooked):
            delete_folder(spark, done.durable_path)
        if not after.where("label <> was").limit(1).count():
            delete_folder(spark, both.durable_path)
            return after.select("node", "label")
        labels = after

"""Exact joins of sets by Jaccard similarity, with keys that only similar sets share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.plans.durable import broadcast_if_small, durable

MAX_BROADCAST_CLASSES = 500_000
SIZED = 16  # sets of up to so many elements are joined by the sizes of both sides


def set_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets: ``rep, set, n`` for each, and ``id, rep`` for each set of ``id, entity`` rows.

    ``rep`` is the smallest id with that set. Only classes of several sets are looked up again, so a set that a
    third of all ids share costs one row of the lookup.
    """
    shaped = durable(rows.where("id IS NOT NULL AND entity IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("set")).withColumn("key", F.xxhash64("set")), "sets")
    classes = durable(shaped.groupBy("key", "set").agg(F.min("id").alias("rep"), F.count("*").alias("many")), "classes")
    shared = broadcast_if_small(durable(classes.where("many > 1").select("key", "set", "rep"), "shared"), MAX_BROADCAST_CLASSES)
    members = shaped.join(shared, ["key", "set"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return classes.select("rep", "set", F.size("set").alias("n")), members


def element_counts(*sides: DataFrame) -> DataFrame:
    """``entity, f``: in how many sets (``set``) of all sides an element stands."""
    every = sides[0].select("set")
    for side in sides[1:]:
        every = every.unionByName(side.select("set"))
    return durable(every.select(F.explode("set").alias("entity")).groupBy("entity").agg(F.count("*").alias("f")), "counts")


def _needs(n: int, m: int, t: float) -> int:
    """How many elements sets of sizes ``n`` and ``m`` must share."""
    return math.ceil(t / (1 + t) * (n + m) - 1e-9)


def _links(n: int, m: int, t: float) -> bool:
    """Whether different sets of sizes ``n`` and ``m`` can link; equal sizes that must share all are equal sets."""
    return _needs(n, m, t) <= min(n, m) and not (n == m and _needs(n, m, t) >= n)


def join_keys(classes: DataFrame, counts: DataFrame, threshold: float, equal: bool = False) -> DataFrame:
    """``rep, n, key, place``: keys of each set (``rep, set, n``), at least one of which two similar sets have in common.

    Elements are put in one order, rare ones first (elements that ``counts`` lacks are rarest); any order is right as long as
    both sides use the same. Sets of sizes n and m must share k elements, so the first two that they share stand among
    the first ``n - k + 2`` and ``m - k + 2``: pairs of those are the keys where k is two or more, single
    elements else. Pairs are rare even where every single element is frequent. Sets of up to ``SIZED`` elements have each
    pair once for all sizes of a partner; ``place`` is where its later element stands, which tells for which sizes it counts.
    Single elements are keyed for each size of a partner (``place`` is that size, negative), so that sizes that cannot link never
    meet; larger sets are keyed by single elements for any size (``place`` 0). With ``equal`` the set as a whole is a key too
    (``place`` 1); without it equal sets need not meet.
    """
    t = float(threshold)
    items = classes.select("rep", F.explode("set").alias("entity"))
    ranked = items.join(broadcast_if_small(counts, MAX_BROADCAST_CLASSES), "entity", "left").select("rep", "entity", F.coalesce("f", F.lit(0)).alias("f"))
    ordered = ranked.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "entity"))), lambda x: x["entity"]).alias("o")).withColumn("n", F.size("o"))
    n = F.col("n")
    least = F.greatest(F.lit(1), F.ceil(n * t - 1e-9).cast("int"))
    most = F.floor(n / t + 1e-9).cast("int")
    needs = [[(m, _needs(size, m, t)) for m in range(1, SIZED + 1) if _links(size, m, t)] for size in range(1, SIZED + 1)]
    reach = [max((size - k + 2 for _, k in of if k > 1), default=0) for size, of in enumerate(needs, 1)]
    alone = [F.array(*(F.lit(m) for m, k in of if k == 1)).cast("array<int>") for of in needs]
    known = lambda values: F.get(F.array(*values), n - 1)
    sized = ordered.withColumn("p", F.slice("o", F.lit(1), F.coalesce(known(map(F.lit, reach)), F.lit(0))))
    key = lambda hashed, place: F.struct(hashed.alias("key"), place.cast("int").alias("place"))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y, k: key(F.xxhash64(x, y), i + k + 2))))
    lone = F.coalesce(known(alone), F.array().cast("array<int>"))
    singles = F.flatten(F.transform(lone, lambda m: F.transform("o", lambda x: key(F.xxhash64(x, F.least(n, m), F.greatest(n, m)), -m))))
    wide = F.transform(F.slice("o", F.lit(1), F.when((n > SIZED) | (most > SIZED), n - least + 1).otherwise(0)), lambda x: key(F.xxhash64(x), F.lit(0)))
    keys = [pairs, *([singles] if any(k == 1 for of in needs for _, k in of) else []), wide] + ([F.array(key(F.xxhash64(F.array_sort("o")), F.lit(1)))] if equal else [])
    return sized.select("rep", "n", F.explode(F.concat(*keys)).alias("k")).select("rep", "n", "k.key", "k.place")


def keys_meet(x: str, y: str, threshold: float) -> Column:
    """Whether rows of ``join_keys`` under the aliases ``x`` and ``y`` make their sets candidates."""
    t = float(threshold)
    col = lambda side, name: F.col(f"{side}.{name}")
    n, m, at, other = col(x, "n"), col(y, "n"), col(x, "place"), col(y, "place")
    larger, smaller = F.greatest(n, m), F.least(n, m)
    need = F.ceil(F.lit(t / (1 + t)) * (n + m) - 1e-9)
    pair = (other > 1) & (need > 1) & (need <= smaller) & ((n != m) | (need < n)) & (at <= n - need + 2) & (other <= m - need + 2)
    wide = (other == 0) & (larger > SIZED) & (smaller >= F.lit(t) * larger - 1e-9)
    return (col(x, "key") == col(y, "key")) & F.when(at > 1, pair).when(at == 1, other == 1).when(at == 0, wide).otherwise((at == -m) & (other == -n))


def confirmed(met: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the candidate pairs ``a, b`` whose sets (``rep, set, n`` of either side) reach the threshold."""
    side = lambda df, s: df.select(F.col("rep").alias(s), F.col("set").alias(f"set_{s}"), F.col("n").alias(f"n_{s}"))
    both = met.join(side(left, "a"), "a").join(side(right, "b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("similarity")).where(F.col("similarity") >= float(threshold) - 1e-12)


def class_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` (``a < b``) of different sets (``rep, set, n``) with Jaccard at or above ``threshold``."""
    keys = durable(join_keys(classes, element_counts(classes), threshold), "keys")
    met = keys.alias("x").join(keys.alias("y"), keys_meet("x", "y", threshold) & (F.col("x.rep") < F.col("y.rep")))
    return confirmed(met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), classes, classes, threshold)


def cross_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of a left and a right set (``rep, set, n``), equal ones included; pairs inside a side are not looked for."""
    counts = element_counts(left, right)
    x, y = (join_keys(side, counts, threshold, equal=True).alias(name) for side, name in ((left, "x"), (right, "y")))
    met = x.join(y, keys_meet("x", "y", threshold)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    return confirmed(met, left, right, threshold)


def jaccard_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``left_id, right_id, similarity`` of set pairs with Jaccard at or above ``threshold``; sides are ``id, entity`` rows.

    Equal sets of a side are compared once; the result is every pair of their members.
    """
    (left_classes, left_members), (right_classes, right_members) = set_classes(left), set_classes(right)
    near = durable(cross_pairs(left_classes, right_classes, threshold), "near")
    named = near.join(left_members.select(F.col("id").alias("left_id"), F.col("rep").alias("a")), "a")
    return named.join(right_members.select(F.col("id").alias("right_id"), F.col("rep").alias("b")), "b").select("left_id", "right_id", "similarity")

"""Fuzzy entity matching between articles: blocked name pairs, overlap counts, greedy one-to-one scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions import names as N
from newsweave.operators.aliases import equivalent_names, sorted_pair
from newsweave.plans.durable import durable

WEIGHTS = {"PRIMARY": 1.0, "SECONDARY": 0.6, "MENTIONED": 0.3}


def blocking_keys(normal: Column, raw: Column) -> Column:
    """Keys that two matching names mostly share: each token, the first and last four characters, and all runs of initials.

    With ``names.edit_keys`` and ``containment_keys`` no pair that matches by its edit distance, by its acronym or
    by containment is missed; pairs that match by Jaro-Winkler alone are, if they agree in none of these keys.
    """
    tokens = F.split(normal, " ")
    squeezed = F.replace(normal, F.lit(" "), F.lit(""))
    initials = F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")
    ends = F.sequence(F.lit(1), F.length(initials))
    runs = F.flatten(F.transform(ends, lambda i: F.transform(F.sequence(i, F.length(initials)), lambda j: F.concat(F.lit("t:"), F.substr(initials, i, j - i + 1)))))
    keys = F.concat(
        F.transform(tokens, lambda t: F.concat(F.lit("t:"), t)),
        F.array(F.concat(F.lit("p:"), F.substring(squeezed, 1, 4)), F.concat(F.lit("e:"), F.reverse(F.substring(F.reverse(squeezed), 1, 4)))),
        F.when((F.size(tokens) > 1) & (F.size(tokens) <= 12), runs).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) > 2))


def containment_keys(normal: Column, kind: Column) -> Column:
    """For products and organisations: the first four characters, and every four in a row, so that a part meets its whole."""
    grams = F.transform(F.sequence(F.lit(1), F.length(normal) - 3), lambda i: F.concat(F.lit("g:"), F.substr(normal, i, F.lit(4))))
    return F.when(kind.isin("PRODUCT", "ORGANIZATION") & (F.length(normal) >= 4), F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def spelling_keys(normal: Column, kind: Column) -> Column:
    """For the exact mode: keys of which two forms at or above their Jaro-Winkler threshold share one at least.

    Forms that share their first four characters meet by other keys. Any other such forms agree in ``m`` characters
    with ``m (1 / n + 1 / k) >= 3 j - 1`` for lengths n and k, where j is the Jaro value that the threshold needs
    with the bonus for a common start of three; products and organisations may meet, so both take the lower one. So their bags of characters (the second "a" is
    another element than the first) overlap by ``m``, and the rarest characters of each, as many as that leaves
    over plus one, must meet; the order of rarity is fixed. Keys name the partner's length, within what j allows.
    """
    rare = F.lit("zqjxkvwybpgfmducloinhsrate ")
    jaro = F.when(kind == "PERSON", (0.90 - 0.3) / 0.7).when(kind.isin("PRODUCT", "ORGANIZATION"), (0.80 - 0.3) / 0.7).otherwise((0.85 - 0.3) / 0.7)
    chars = F.array_sort(F.transform(F.split(normal, ""), lambda c: F.struct(F.instr(rare, c).alias("at"), c.alias("c"))))
    bag = F.transform(chars, lambda x, i: F.concat(x["c"], F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y["c"] == x["c"])).cast("string")))
    n = F.length(normal)
    least = F.greatest(F.lit(1), F.ceil(n * (3 * jaro - 2) - 1e-9)).cast("int")
    most = F.floor(n / (3 * jaro - 2) + 1e-9).cast("int")
    agree = lambda k: F.ceil((3 * jaro - 1) / (1 / n + 1 / k) - 1e-9).cast("int")
    keyed = lambda k: F.transform(F.slice(bag, F.lit(1), F.greatest(F.lit(0), n - agree(k) + 1)), lambda c: F.concat_ws(":", F.lit("j"), F.least(n, k).cast("string"), F.greatest(n, k).cast("string"), c))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(least, most), keyed))).otherwise(F.array().cast("array<string>"))


def name_matches(left: DataFrame, right: DataFrame, exact: bool = False) -> DataFrame:
    """``name_a, type_a, name_b, type_b`` of matching names between two tables of ``name, type``.

    Every distinct pair that shares a blocking key is verified once, by the rules of the left type: built-in
    functions settle what they can, the verifier sees the rest. With ``exact`` no match is missed, at the price of many
    more candidates. Keys and ids alone are shuffled; forms are looked up for the pairs that met.
    """
    prepared = lambda df: durable(df.where("name IS NOT NULL").select("name", "type").distinct().withColumn("normal", N.normalize_name("name", "type")).withColumn("id", F.xxhash64("name", "type")), "names")

    def keyed(df: DataFrame, side: str) -> DataFrame:
        normal, kind = F.col("normal"), F.col("type")
        keys = F.array_union(blocking_keys(normal, F.col("name")), N.edit_key_columns(normal, kind, side == "a"))
        keys = F.array_union(keys, spelling_keys(normal, kind)) if exact else keys
        first = F.when(F.length(normal) >= 4, F.array(F.concat(F.lit("g:"), F.substring(normal, 1, 4)))).otherwise(F.array().cast("array<string>"))
        whole, begin = containment_keys(normal, kind), F.when(kind.isin("PRODUCT", "ORGANIZATION"), first).otherwise(F.array().cast("array<string>"))
        marked = lambda x, mark: F.transform(x, lambda k: F.concat(F.lit(mark), k))  # noqa: E731  a's start meets b's grams and the other way round
        parts = F.concat(marked(begin, "a" if side == "a" else "b"), marked(whole, "b" if side == "a" else "a"))
        return df.select(F.col("id").alias(f"id_{side}"), kind.alias(f"type_{side}"), F.explode(F.array_distinct(F.concat(keys, parts))).alias("key"))

    a, b = prepared(left), prepared(right)
    met = keyed(a, "a").join(keyed(b, "b"), "key").where(N.compatible_types(F.col("type_a"), F.col("type_b"))).select("id_a", "id_b").distinct()
    side = lambda df, s: df.select(F.col("id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}"), F.col("type").alias(f"type_{s}"), F.col("normal").alias(f"normal_{s}"))
    pairs = met.join(side(a, "a"), "id_a").join(side(b, "b"), "id_b")
    known = F.when(F.col("normal_a") == F.col("normal_b"), True).otherwise(N.settled(F.col("normal_a"), F.col("normal_b"), F.col("type_a")))
    pairs = durable(pairs.withColumn("known", known).where("known IS NULL OR known"), "name-pairs")
    open_ = pairs.where("known IS NULL").where(N.fuzzy_names(*(F.col(c) for c in ("normal_a", "normal_b", "name_a", "name_b", "type_a"))))
    return pairs.where("known").unionByName(open_).select("name_a", "type_a", "name_b", "type_b")


def same_names(pairs: DataFrame, aliases: DataFrame, negatives: DataFrame, negative_is_final: bool = False) -> DataFrame:
    """``name_a, name_b, type, verdict, evidence`` for pairs of names (``name_a, name_b, type``).

    The order of evidence: equal normal forms, then the alias table, then fuzzy rules. A negative pair ends the
    search only with ``negative_is_final``; else fuzzy rules still decide, as for names that no table knows.
    ``aliases`` and ``negatives`` hold normal forms.
    """
    rows = pairs.select("name_a", "name_b", "type").distinct().withColumns({"a": N.normalize_name("name_a", "type"), "b": N.normalize_name("name_b", "type")})
    rows = durable(rows, "name-pairs")
    known = equivalent_names(rows.where("a <> b").select("a", "b", "type").distinct(), aliases, negatives)
    barred = rows.where("a <> b").select("a", "b", "type", *sorted_pair(F.col("a"), F.col("b"))).distinct().join(negatives.select("name_lo", "name_hi", "type").distinct(), ["name_lo", "name_hi", "type"], "left_semi")
    tabled = rows.join(known.withColumnRenamed("verdict", "tabled"), ["a", "b", "type"], "left").join(barred.select("a", "b", "type", F.lit(True).alias("barred")), ["a", "b", "type"], "left")
    evidence = F.when(F.col("a") == F.col("b"), "normal form").when(F.col("tabled"), "alias")
    if negative_is_final:
        evidence = evidence.when(F.col("barred"), "negative pair")
    tabled = durable(tabled.withColumn("evidence", evidence.otherwise("fuzzy")), "tabled")
    sure = tabled.where("evidence <> 'fuzzy'").withColumn("verdict", F.col("evidence") != "negative pair")
    settled = N.settled(F.col("a"), F.col("b"), F.col("type"))
    rest = tabled.where("evidence = 'fuzzy'").withColumn("s", settled)
    quick = rest.where("s IS NOT NULL").withColumn("verdict", F.col("s"))
    slow = rest.where("s IS NULL").withColumn("verdict", N.fuzzy_names(*(F.col(c) for c in ("a", "b", "name_a", "name_b", "type"))))
    columns = ["name_a", "name_b", "type", "verdict", "evidence"]
    return sure.select(*columns).unionByName(quick.select(*columns)).unionByName(slow.select(*columns))


def overlap_counts(pairs: DataFrame, article_names: DataFrame, matches: DataFrame, primary_only: bool = False) -> DataFrame:
    """``source_id, target_id, overlap``: source entities with at least one match in the target."""
    names = article_names.where("importance = 'PRIMARY'") if primary_only else article_names
    s = names.select(F.col("article_id").alias("source_id"), F.col("name").alias("name_a"), F.col("type").alias("type_a"))
    t = names.select(F.col("article_id").alias("target_id"), F.col("name").alias("name_b"), F.col("type").alias("type_b"))
    hits = pairs.join(s, "source_id").join(matches, ["name_a", "type_a"]).join(t, ["target_id", "name_b", "type_b"])
    found = hits.select("source_id", "target_id", "name_a", "type_a").distinct().groupBy("source_id", "target_id").agg(F.count("*").alias("overlap"))
    return pairs.join(found, ["source_id", "target_id"], "left").na.fill(0, ["overlap"])


def weight(importance: Column) -> Column:
    return F.when(importance == "PRIMARY", WEIGHTS["PRIMARY"]).when(importance == "SECONDARY", WEIGHTS["SECONDARY"]).otherwise(WEIGHTS["MENTIONED"])


def greedy_similarity(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Greedy one-to-one score per (source, target, type).

    ``edges``: ``source_id, target_id, type, s_rank, t_rank, s_importance, t_importance``, a row for every
    matching pair; ``sizes``: ``source_id, target_id, type, n_source, n_target``. Source entities in rank
    order take the first free matching target; the score is the sum of mean weights over the mean size.
    """
    pair = F.struct(F.col("s_rank").alias("s"), F.col("t_rank").alias("t"), ((weight(F.col("s_importance")) + weight(F.col("t_importance"))) / 2).alias("w"))
    lists = edges.groupBy("source_id", "target_id", "type").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))

    def take(done: Column, p: Column) -> Column:
        free = ~F.array_contains(done["s"], p["s"]) & ~F.array_contains(done["t"], p["t"])
        grown = F.struct(F.array_append(done["s"], p["s"]).alias("s"), F.array_append(done["t"], p["t"]).alias("t"), (done["sum"] + p["w"]).alias("sum"))
        return F.when(free, grown).otherwise(done)

    begin = F.struct(F.array().cast("array<int>").alias("s"), F.array().cast("array<int>").alias("t"), F.lit(0.0).alias("sum"))
    folded = lists.select("source_id", "target_id", "type", F.aggregate("pairs", begin, take)["sum"].alias("sum"))
    joined = sizes.join(folded, ["source_id", "target_id", "type"], "left")
    score = F.when((F.col("n_source") > 0) & (F.col("n_target") > 0), F.coalesce("sum", F.lit(0.0)) / ((F.col("n_source") + F.col("n_target")) / 2)).otherwise(0.0)
    return joined.select("source_id", "target_id", "type", score.alias("score"))

"""Match evaluation: pair sampling and confusion statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.plans.durable import durable


def same_day_pairs(articles: DataFrame, per_day: int = 5) -> DataFrame:
    """Up to ``per_day`` pairs of each day's articles: the first with all later ones, then the second, and so on.

    The first ``per_day`` pairs in that order need no more than the first ``per_day + 1`` articles of a day, so
    only those are paired.
    """
    order = Window.partitionBy("day").orderBy("id")
    ids = articles.where("pub_date IS NOT NULL").select("id", F.col("pub_date").cast("date").alias("day")).distinct()
    few = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_day + 1)
    pairs = few.select("day", F.col("id").alias("source_id"), F.col("rank").alias("a")).join(few.select("day", F.col("id").alias("target_id"), F.col("rank").alias("b")), "day").where("a < b")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("a", "b")))
    return ranked.where(F.col("rank") <= per_day).select("day", "source_id", "target_id")


def _permuted(value: Column, bits: int, seed: int, rounds: int = 4) -> Column:
    """A keyed permutation of the numbers of ``bits`` bits (even): a balanced Feistel network with a hash as its round function."""
    half = bits // 2
    mask = F.lit((1 << half) - 1).cast("long")
    left, right = F.shiftright(value, half), value.bitwiseAND(mask)
    pair = F.struct(left.alias("l"), right.alias("r"))
    for k in range(rounds):
        turn = lambda p, k=k: F.struct(p["r"].alias("l"), p["l"].bitwiseXOR(F.xxhash64(p["r"], F.lit(seed), F.lit(k)).bitwiseAND(mask)).alias("r"))
        pair = F.transform(F.array(pair), turn)[0]
    return F.transform(F.array(pair), lambda p: F.shiftleft(p["l"], half).bitwiseOR(p["r"]))[0]


def random_pairs(articles: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``source_id, target_id`` (``source_id < target_id``): exactly ``n`` different unordered pairs drawn by ``seed``, or all there are.

    Articles are numbered from 0; the pairs of m articles have numbers from 0 to m (m - 1) / 2. A keyed permutation of
    the next even power of two is walked in order, and the first ``n`` values that are numbers of pairs are turned into pairs. At most
    four values are needed for each pair on average, no pair is drawn twice and none is left out. Numbering takes one
    narrow pass and one row a partition on the driver.
    """
    ids = articles.select("id").where("id IS NOT NULL").distinct()
    numbered = durable(with_row_numbers(ids, "id"), "numbered")
    m = numbered.count()
    total = m * (m - 1) // 2
    if not total or n <= 0:
        return ids.select(F.col("id").alias("source_id"), F.col("id").alias("target_id")).limit(0)
    bits = max(8, (total - 1).bit_length())  # fewer give few orders
    bits += bits % 2
    spark = articles.sparkSession
    if n >= total:
        drawn = spark.range(total).select(F.col("id").alias("pair"))
    else:
        # a stretch of the walk that holds n pair numbers; it is lengthened in the rare case that it does not
        length = min(1 << bits, int(n * (1 << bits) / total * 1.1) + 64)
        while True:
            drawn = durable(spark.range(length).select(F.col("id").alias("step"), _permuted(F.col("id"), bits, seed).alias("pair")).where(F.col("pair") < total), "walk")
            if length == 1 << bits or drawn.count() >= n:
                break
            length = min(1 << bits, 2 * length)
        drawn = _first_steps(drawn, n).select("pair")
    # pair number p stands for (i, j), i < j, with p = j (j - 1) / 2 + i
    guess = F.floor((F.sqrt(8 * F.col("pair").cast("double") + 1) + 1) / 2).cast("long")
    exact = lambda j: F.expr(f"({j} * ({j} - 1)) DIV 2")
    pairs = drawn.withColumn("g", guess).withColumn("j", F.when(exact("g") > F.col("pair"), F.col("g") - 1).when(exact("(g + 1)") <= F.col("pair"), F.col("g") + 1).otherwise(F.col("g"))).withColumn("i", F.col("pair") - exact("j"))
    side = lambda at, name: numbered.select(F.col("row").alias(at), F.col("id").alias(name))
    met = pairs.join(side("i", "a"), "i").join(side("j", "b"), "j")
    return met.select(F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"))


def _first_steps(drawn: DataFrame, n: int, size: int = 1 << 16) -> DataFrame:
    """The ``n`` rows of smallest ``step``: whole blocks of steps, and the begin of one block, which alone is sorted."""
    blocks = drawn.groupBy(F.floor(F.col("step") / size).alias("block")).agg(F.count("*").alias("n")).orderBy("block").collect()  # one row for each 65,536 steps
    had = 0
    for block in blocks:
        if had + block.n >= n:
            whole = drawn.where(F.col("step") < block.block * size)
            last = drawn.where((F.col("step") >= block.block * size) & (F.col("step") < (block.block + 1) * size)).orderBy("step").limit(n - had)
            return whole.unionByName(last)
        had += block.n
    return drawn


def with_row_numbers(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with numbers from 0 (``row``) by ``order``: numbers inside sorted ranges plus the sizes of the ranges before."""
    ranged = durable(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    begin, at = {}, 0
    for part in sorted(sizes):
        begin[part], at = at, at + sizes[part]
    if not begin:
        return ranged.select(*rows.columns, F.lit(0).cast("long").alias("row"))
    first = F.element_at(F.create_map(*(F.lit(x) for pair in begin.items() for x in pair)), F.col("part")).cast("long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("row", first + inside).drop("part")


def pair_set(articles: DataFrame, n: int, per_day: int = 5, seed: int = 0) -> DataFrame:
    """Same-day pairs, filled up with random pairs to ``n`` unordered pairs where there are fewer."""
    near = same_day_pairs(articles, per_day).select("source_id", "target_id")
    lacking = max(0, n - near.count())
    if not lacking:
        return near
    known = near.select(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id"))
    more = random_pairs(articles, n, seed).join(known, ["source_id", "target_id"], "left_anti")  # n pairs less all known ones are enough
    return near.unionByName(more.orderBy(F.xxhash64("source_id", "target_id", F.lit(seed)), "source_id", "target_id").limit(lacking))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A pair list as headed CSV, as ``pair_list`` reads it."""
    have = [c for c in ("source_id", "target_id", "expected") if c in pairs.columns]
    pairs.select(*have).write.csv(path, header=True)


def write_results(results: DataFrame, path: str) -> None:
    """The rows of ``result_rows`` as headed CSV."""
    result_rows(results).write.csv(path, header=True)


def pair_list(lines: DataFrame) -> DataFrame:
    """``source_id, target_id, expected`` from CSV text rows (``value``); a header and broken lines go."""
    parts = F.split("value", ",")
    word = F.lower(F.trim(F.get(parts, F.lit(2))))
    expected = F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)
    rows = lines.select(F.trim(parts[0]).try_cast("long").alias("source_id"), F.trim(F.get(parts, F.lit(1))).try_cast("long").alias("target_id"), expected.alias("expected"))
    return rows.where("source_id IS NOT NULL AND target_id IS NOT NULL")


def batch_stats(results: DataFrame) -> DataFrame:
    """One row: pairs, match rate, labelled accuracy, false positives and negatives, mean scores and shared entities by outcome."""
    hit, expected = F.col("is_match"), F.col("expected")
    mean = lambda c, on: F.avg(F.when(on, F.col(c)))
    return results.agg(
        F.count("*").alias("pairs"), F.count_if(hit).alias("matched"), (F.count_if(hit) / F.count("*")).alias("match_rate"), F.count("expected").alias("labelled"),
        F.count_if(expected == hit).alias("correct"), F.count_if(hit & ~expected).alias("false_positives"), F.count_if(~hit & expected).alias("false_negatives"),
        mean("score", hit).alias("score_matched"), mean("score", ~hit).alias("score_other"), mean("vector_score", hit).alias("vector_matched"), mean("vector_score", ~hit).alias("vector_other"),
        mean("entity_score", hit).alias("entity_matched"), mean("entity_score", ~hit).alias("entity_other"), mean("overlap", hit).alias("shared_matched"), mean("overlap", ~hit).alias("shared_other"),
    )


def reason_histogram(results: DataFrame) -> DataFrame:
    key = F.regexp_replace("reason", r"\s*\(.*\)$", "")
    return results.where("NOT is_match").groupBy(key.alias("reason")).agg(F.count("*").alias("pairs"))


# The columns of the result file.
RESULT_COLUMNS = (
    "source_id", "target_id", "match_status", "combined_score", "vector_score", "entity_score", "shared_entities", "primary_shared",
    "person_overlap", "org_overlap", "location_overlap", "event_overlap", "reason", "expected_match", "expected_vs_actual",
)


def result_rows(results: DataFrame) -> DataFrame:
    """All fifteen columns of the result file; commas in the reason become semicolons, scores have two digits."""
    have = set(results.columns)
    number = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0))) if c in have else F.lit("0.00")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)
    verdict = F.when(F.col("expected").isNull(), "unknown").when(F.col("expected") == F.col("is_match"), "correct").otherwise("incorrect")
    values = (
        F.col("source_id"), F.col("target_id"), F.col("is_match"), number("score"), number("vector_score"), number("entity_score"), count("overlap"), count("primary_overlap"), number("person"),
        number("organization"), number("location"), number("event"), F.replace("reason", F.lit(","), F.lit(";")), F.coalesce(F.col("expected").cast("string"), F.lit("unknown")), verdict,
    )
    return results.select(*[v.alias(n) for v, n in zip(values, RESULT_COLUMNS, strict=True)])

"""Embedding operators: cosine, exact nearest neighbours in blocks, statistics, repair lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.functions import text as T

LEAST_NORM = 0.001


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null when lengths differ or a norm is under 0.001."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) == F.size(b)) & (na >= LEAST_NORM) & (nb >= LEAST_NORM), dot(a, b) / (na * nb))


def vector_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Mean, population variance and deviation, extremes, active places (above the mean) and magnitude of each vector."""
    v = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.withColumn("v", v).withColumn("mean", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v"))
    spread = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("v")
    rows = rows.withColumn("variance", spread)
    keep = [c for c in vectors.columns if c != column]
    return rows.select(
        *keep, "mean", "variance", F.sqrt("variance").alias("std"), F.array_min("v").alias("least"), F.array_max("v").alias("most"), F.size(F.filter("v", lambda x: x > F.col("mean"))).cast("long").alias("active"), norm(F.col("v")).alias("magnitude")
    )


def vector_status(vector: Column, size: int) -> Column:
    """``missing``, ``wrong_size``, ``zero`` or ``ok``."""
    return F.when(vector.isNull(), "missing").when(F.size(vector) != size, "wrong_size").when(norm(vector) < LEAST_NORM, "zero").otherwise("ok")


def mean_pool(tokens: DataFrame) -> DataFrame:
    """``id, embedding``: the unit-length mean of each id's unmasked token vectors (``id, mask, vector``)."""
    parts = tokens.where("mask = 1").select("id", F.posexplode("vector").alias("at", "x")).groupBy("id", "at").agg(F.avg("x").alias("x"))
    pooled = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v"))
    return pooled.select("id", F.when(norm(F.col("v")) > 0, F.transform("v", lambda x: x / norm(F.col("v")))).otherwise(F.col("v")).alias("embedding"))


def recent(vectors: DataFrame, as_of: str, days: int = 14, column: str = "published") -> DataFrame:
    """Vectors published after ``days`` days before ``as_of``; the filter reaches the scan."""
    return vectors.where(F.col(column) > T.as_time(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def repair_rows(articles: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """``id, status, text, pub_date, event_date, category, quality`` of articles whose vector is missing or not usable."""
    from newsweave.operators.articles import article_details, article_text

    found = articles.select("id", "pub_date").join(vectors.select("id", "embedding"), "id", "left").select("id", "pub_date", vector_status(F.col("embedding"), size).alias("status")).where("status <> 'ok'")
    details = article_details(articles).select("id", "event_date", "category", "quality")
    return found.join(article_text(articles), "id").join(details, "id").select("id", "status", "text", "pub_date", "event_date", "category", "quality")


def listed_pairs(vectors: DataFrame, most: int = 1000) -> DataFrame:
    """``a, b, score`` for all pairs (``a < b``) of a short list of vectors: a check of a handful of ids, not a search; more than ``most`` are refused."""
    if vectors.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} vectors: use cosine_top_k")
    side = lambda s: vectors.select(F.col("id").alias(s), F.col("embedding").alias(f"e_{s}"))
    return side("a").join(side("b"), F.col("a") < F.col("b")).select("a", "b", cosine(F.col("e_a"), F.col("e_b")).alias("score"))


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int, threshold: float, part_rows: int = 1 << 16) -> DataFrame:
    """Exact top ``k`` of ``corpus`` (``id, embedding``) by cosine for each row of ``queries``, self excluded.

    The corpus is dealt once into parts of about ``part_rows`` vectors; every query goes to every part. Within a
    partition a part's vectors come first and make one matrix, then queries stream past it in Arrow batches and
    leave their best ``k`` of the part, so memory holds one part and one batch. Vectors of different lengths
    never meet. Ties fall to the smaller id.
    """
    usable = lambda df: df.where(norm(F.col("embedding")) >= LEAST_NORM).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    parts = max(1, -(-corpus.count() // part_rows))
    c = usable(corpus).select("dim", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "embedding")
    q = usable(queries).select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "embedding")
    rows = c.unionByName(q).repartition(max(parts, 1), "dim", "part").sortWithinPartitions("dim", "part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, matrix, held = None, None, None, []
        for batch in batches:
            dims, numbers, kinds, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3))
            values = batch.column(4)
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if lo == hi:
                    continue
                block = values.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, int(dims[lo]))
                block = block / np.linalg.norm(block, axis=1, keepdims=True)
                if at != (dims[lo], numbers[lo]):
                    at, names, matrix, held = (dims[lo], numbers[lo]), None, None, []
                if kinds[lo] == 0:
                    held.append((ids[lo:hi], block))
                    continue
                if matrix is None and held:
                    names, matrix, held = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), []
                if matrix is not None:
                    yield from _best(ids[lo:hi], block, names, matrix, k, threshold)

    found = rows.mapInArrow(search, "source_id long, target_id long, score double")
    best = Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _best(ids: np.ndarray, block: np.ndarray, names: np.ndarray, matrix: np.ndarray, k: int, threshold: float, at_once: int = 256) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of ``matrix`` for each row of ``block``."""
    for lo in range(0, len(ids), at_once):
        own = ids[lo : lo + at_once]
        scores = block[lo : lo + at_once] @ matrix.T
        scores[own[:, None] == names[None, :]] = -2.0
        rows, cols = np.nonzero(scores >= threshold)
        found = scores[rows, cols]
        order = np.lexsort((names[cols], -found, rows))
        rows, cols, found = rows[order], cols[order], found[order]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < k
        yield pa.RecordBatch.from_arrays([pa.array(own[rows[keep]]), pa.array(names[cols[keep]]), pa.array(found[keep])], ["source_id", "target_id", "score"])


def similar_by_vector(queries: DataFrame, corpus: DataFrame, as_of: str, k: int = 10, threshold: float = 0.80, days: int = 14) -> DataFrame:
    """``source_id, target_id, score, quality, position``: the best ``k`` recent vectors of each query, best quality first.

    ``corpus``: ``id, embedding, published, quality``. Among equal qualities the higher score comes first.
    """
    hits = cosine_top_k(queries, recent(corpus, as_of, days), k, threshold)
    rows = hits.join(corpus.select(F.col("id").alias("target_id"), F.coalesce("quality", F.lit(0)).alias("quality")), "target_id")
    order = Window.partitionBy("source_id").orderBy(F.desc("quality"), "rank")
    return rows.select("source_id", "target_id", "score", "quality", F.row_number().over(order).cast("long").alias("position"))


def lsh_top_k(queries: DataFrame, corpus: DataFrame, k: int, threshold: float, tables: int = 12, width: float = 0.8, seed: int = 7) -> DataFrame:
    """Like ``cosine_top_k`` for corpora too large to compare with: random projections choose the pairs that are compared.

    On unit vectors a cosine of ``threshold`` is a distance of ``sqrt(2 - 2 * threshold)``. Pairs that share no bucket of
    any table are missed; more tables or wider buckets find more and compare more. Scores are exact.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    def unit(df: DataFrame) -> DataFrame:
        rows = df.withColumn("norm", norm(F.col("embedding"))).where(F.col("norm") >= LEAST_NORM)
        return rows.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.greatest("norm", F.lit(LEAST_NORM)))).alias("v"))

    q, c = unit(queries), unit(corpus)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="buckets", bucketLength=width, numHashTables=tables, seed=seed).fit(c)
    met = model.approxSimilarityJoin(q, c, (2 - 2 * threshold) ** 0.5 + 1e-9, "distance")
    found = met.select(F.col("datasetA.id").alias("source_id"), F.col("datasetB.id").alias("target_id"), (1 - F.col("distance") ** 2 / 2).alias("score")).where("source_id <> target_id")
    best = Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)

"""Exact k-means over integer vectors, with distance bounds that are loosened by net displacements (ns-bounds).

Every vector keeps its exact squared distance to each centroid as of the round in which it was last evaluated, and that
round's number. The history of all centroids is kept too, so in a later round the distance is bounded by the stored one
plus or minus the norm of the centroid's total displacement since then, not the sum of its drifts, which is never
smaller. A vector keeps its cluster without any evaluation if the upper bound of its own centroid lies below
the lower bounds of all others; else its own distance is evaluated, then exactly those centroids whose bound still
fails. Distances, sums and means are integers, so results do not depend on the order of rows, partitions or processes;
bounds are floating point and are widened by far more than their rounding.

In Spark: each round is one pass over the state (vectors and bounds), written to the shared folder in place of the round
before, so a lost executor repeats only tasks of one round. The pass also writes, once per partition, how much
the vectors that changed cluster add to and take from each cluster; these sums are added up by components, which brings
``k * (dims + 1)`` numbers to the driver whatever the size. Nothing is shuffled but those partial sums. The history that
is broadcast has ``(rounds + 1) * k * dims`` numbers. If no centroid changes, the remaining rounds are skipped, as they
would change nothing.

Edge cases. Vectors that are null, of another length or with a null, NaN or infinite component are left out. Repeated rows and
equal vectors are clustered each; rows of one id may differ in their vectors. A null id never sorts before another id when
starts are chosen. With fewer than ``k`` kept vectors there are as many clusters as vectors; an empty
table gives no rows. A component beyond ``LIMIT`` after scaling raises an error, since squared distances would not fit a long.
Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.plans.durable import delete_folder, durable

LIMIT = 1 << 27  # 64 squares of twice this fit a long
_WIDER = 1e-9  # relative and absolute slack of bounds, far above the rounding of square roots and sums


def integer_vectors(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as integers."""
    whole = np.floor(values.astype(np.float64) * scale)
    if whole.size and np.abs(whole).max() > LIMIT:
        raise ArithmeticError(f"a component is beyond {LIMIT} after scaling by {scale}; squared distances would not fit a long")
    return whole.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...d,...d->...", gap, gap)


class Bounds:
    """Cluster, last evaluated squared distances and the rounds of their evaluation, for a batch of vectors."""

    def __init__(self, cluster: np.ndarray, distance: np.ndarray, evaluated: np.ndarray):
        self.cluster, self.distance, self.evaluated = cluster, distance, evaluated

    @staticmethod
    def fresh(vectors: np.ndarray, centroids: np.ndarray, now: int) -> Bounds:
        distance = np.stack([squared(vectors, c) for c in centroids], axis=1)
        return Bounds(np.argmin(distance, axis=1), distance, np.full(distance.shape, now))

    def reassign(self, vectors: np.ndarray, history: np.ndarray, now: int) -> int:
        """Assign to the nearest of ``history[now]`` (ties: smaller number); the number of distances that were evaluated."""
        rows = np.arange(len(vectors))
        moved = np.sqrt(squared(history[now][None], history[: now + 1]).astype(np.float64))  # by round of evaluation and centroid
        drift = moved[self.evaluated, np.arange(history.shape[1])]
        known = np.sqrt(self.distance.astype(np.float64))
        lower = (known - drift) - _WIDER * (1 + known + drift)
        own = known[rows, self.cluster] + drift[rows, self.cluster]
        upper = own + _WIDER * (1 + own)
        lower[rows, self.cluster] = np.inf
        fails = np.flatnonzero(upper >= lower.min(axis=1, initial=np.inf))
        if not len(fails):
            return 0
        mine = self.cluster[fails]
        exact = squared(vectors[fails], history[now][mine])
        self.distance[fails, mine], self.evaluated[fails, mine] = exact, now
        root = np.sqrt(exact.astype(np.float64))
        at, other = np.nonzero((root + _WIDER * (1 + root))[:, None] >= lower[fails])
        self.distance[fails[at], other] = squared(vectors[fails[at]], history[now][other])
        self.evaluated[fails[at], other] = now
        rivals = np.where(self.evaluated[fails] == now, self.distance[fails], np.iinfo(np.int64).max)
        self.cluster[fails] = np.argmin(rivals, axis=1)
        return len(fails) + len(at)


def _fixed(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    flat = np.ascontiguousarray(matrix)
    width = flat.strides[0] if len(flat) else 1
    return pa.Array.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _matrix(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(kind).reshape(-1, width)


def _floats(column: pa.Array, dims: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dims)


def kept_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, embedding`` of the rows with exactly ``dims`` components, none null, NaN or infinite."""
    chosen = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return chosen.where((F.size("embedding") == dims) & finite)


def start_centroids(kept: DataFrame, k: int, scale: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of ``salt:id``, in order of the hash."""
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), "embedding")
    rows = hashed.orderBy(F.asc_nulls_last("hash"), "embedding").limit(k).collect()
    return integer_vectors(np.array([r.embedding for r in rows]), scale)


def _round(source: DataFrame, history: np.ndarray, now: int, scale: int, last: bool) -> DataFrame:
    """One assignment of all vectors; unless it is the last, partial sums of those that moved follow in each partition."""
    _, k, dims = history.shape
    shared = source.sparkSession.sparkContext.broadcast(history)  # (rounds + 1) * k * dims numbers
    first = "embedding" in source.columns
    kind = source.schema["vec_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = shared.value
        moved = np.zeros((k, dims + 1), np.int64)
        ids = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            if first:
                x = integer_vectors(_floats(batch.column(1), dims), scale)
                before, state = None, Bounds.fresh(x, past[now], now)
            else:
                x = _matrix(batch.column(1), np.dtype("<i4"), dims).astype(np.int64)
                before = batch.column(2).to_numpy().astype(np.int64)
                distance = _matrix(batch.column(3), np.dtype("<i8"), k).copy()
                state = Bounds(before.copy(), distance, _matrix(batch.column(4), np.dtype(np.uint8), k).astype(np.int64))
                state.reassign(x, past, now)
            if last:
                yield pa.RecordBatch.from_arrays([ids, pa.array(state.cluster.astype(np.int32)), pa.array(squared(x, past[now][state.cluster]))], ["vec_id", "cluster", "distance"])
                continue
            for j in range(k):
                come = (state.cluster == j) & (before != j) if before is not None else state.cluster == j
                gone = (state.cluster != j) & (before == j) if before is not None else np.zeros(len(x), bool)
                moved[j, :dims] += x[come].sum(axis=0) - x[gone].sum(axis=0)
                moved[j, dims] += come.sum() - gone.sum()
            columns = [ids, _fixed(x.astype("<i4")), pa.array(state.cluster.astype(np.int32)), _fixed(state.distance.astype("<i8")), _fixed(state.evaluated.astype(np.uint8)), pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "cluster", "distances", "evaluated", "moved"])
        if not last and ids is not None and moved.any():
            blank = [pa.nulls(1, t) for t in (ids.type, pa.binary(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([moved.reshape(-1).tolist()], pa.list_(pa.int64()))], ["vec_id", "vector", "cluster", "distances", "evaluated", "moved"])

    if last:
        return source.mapInArrow(scan, f"vec_id {kind}, cluster int, distance bigint")
    return source.mapInArrow(scan, f"vec_id {kind}, vector binary, cluster int, distances binary, evaluated binary, moved array<bigint>")


def _moved(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """What every cluster has gained since the round before, components and count, as exact Python integers."""
    parts = state.where("moved IS NOT NULL").select(F.posexplode("moved").alias("at", "x"))
    total = np.zeros(k * (dims + 1), object)
    for r in parts.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k * (dims + 1) rows at most
        total[r["at"]] = int(r["x"])
    return total.reshape(k, dims + 1)


def clustered(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each kept vector.

    Components are scaled to integers by ``floor(scale * x)``. Each of ``rounds`` rounds assigns every vector to the nearest
    centroid (squared Euclidean distance; ties: smaller number) and moves every non-empty centroid to the floor of its mean;
    then vectors are assigned once more.
    """
    if not 0 < rounds < 255:
        raise ValueError("rounds are kept in one byte")
    spark = vectors.sparkSession
    state = kept_vectors(vectors, dims, id_col, vector_col)
    start = start_centroids(state, k, scale, salt)
    if not len(start):
        empty = spark.createDataFrame([], f"vec_id {state.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")
        return empty.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))))
    k = len(start)
    history, sums, previous = [start], np.zeros((k, dims + 1), object), None
    for now in range(rounds):
        previous = durable(_round(state, np.stack(history), now, scale, False), f"kmeans-{now}", replaces=previous)
        state = previous.where("moved IS NULL").drop("moved")
        sums = sums + _moved(previous, k, dims)
        after = np.array([[x // row[-1] for x in row[:-1]] if row[-1] else history[-1][j] for j, row in enumerate(sums)], np.int64)
        if (after == history[-1]).all():
            break
        history.append(after)
    found = durable(_round(state, np.stack(history), len(history) - 1, scale, True), "kmeans")
    delete_folder(spark, previous.durable_path)
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]

    def by_cluster(values: dict, kind: str) -> F.Column:
        return F.element_at(F.create_map(*(x for key, v in values.items() for x in (F.lit(key), F.lit(v).cast(kind)))), F.col("cluster"))

    return found.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster(inertia, "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        by_cluster(dict(enumerate(digest)), "string").alias("centroid_sha256"),
    )


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same clustering as one chain of common table expressions, every round over all vectors."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS cluster, v AS c FROM kept
  QUALIFY cluster < {k})""",
    ]

    def nearest(t: int) -> str:
        gap = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""a{t} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(distance := CAST({gap} AS BIGINT), cluster := cluster)) AS best
  FROM kept, c{t} GROUP BY row)"""

    for t in range(rounds):
        parts.append(nearest(t))
        parts.append(
            f"""m{t} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY axis) AS c
  FROM (SELECT best.cluster AS cluster, axis, sum(v[axis])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{t}, range(1, {dims + 1}) r(axis) GROUP BY ALL)
  GROUP BY cluster)"""
        )
        parts.append(f"c{t + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m{t}.c, o.c) AS c FROM c{t} o LEFT JOIN m{t} ON m{t}.cluster = o.cluster)")
    parts.append(nearest(rounds))
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.distance AS distance,
  CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""
    )


ORACLE_SQL = _oracle()

import hashlib

import numpy as np
import pytest
from compare import same_rows

from newsweave.llm import ns_kmeans as K
from newsweave.llm import queries


def brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, best) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    best = assign()
    total = sum(d for d, _ in best)
    part = {j: sum(d for d, c in best if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, part[c], total, digest[c]) for (i, _), (d, c) in zip(kept, best)), key=repr)


def small_rows():
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(0, 0.3, 64) + (k % 5)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(60)]  # copies, ties
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[5][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [float("nan")]), (2005, [1.0] * 63 + [float("-inf")])]
    rows += [(3000 + k, [round(-0.5 / 1024, 9)] * 64) for k in range(20)]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_small_rows(spark, parts):
    df = spark.createDataFrame([(*r, "x", 3) for r in small_rows()], "vec_id long, embedding array<float>, cluster string, moved int").repartition(parts)
    assert got(K.clustered(df)) == brute(small_rows())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(k, [0.25] * 64) for k in range(12)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(K.clustered(df)) == brute(rows)


def test_query_matches_sql(spark, sf_dir):
    same_rows(queries.op11_ns_bounds_clustering(spark, sf_dir), queries.ORACLE_SQL["op11_ns_bounds_clustering"], sf_dir)


def test_vectors_beyond_long_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        K.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


def test_bounds_spare_evaluations_and_stay_exact():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 50, (3000, 16)) + rng.normal(0, 400, (6, 16))[rng.integers(0, 6, 3000)]).astype(np.int64)
    history = [x[:9].copy()]
    state = K.Bounds.fresh(x, history[0], 0)
    evaluated = 0
    for now in range(1, 12):
        history.append(np.array([x[state.cluster == j].sum(axis=0) // max((state.cluster == j).sum(), 1) for j in range(9)]))
        evaluated += state.reassign(x, np.stack(history), now)
        assert (state.cluster == np.argmin([K.squared(x, c) for c in history[now]], axis=0)).all()
    assert evaluated < 0.6 * 11 * 9 * len(x)


def test_net_displacement_is_used_not_the_sum_of_drifts():
    """A centroid that goes far away and comes back leaves the stored bounds as they were: nothing is evaluated."""
    x = np.array([[0, 0], [100, 0]])
    away = np.array([[0, 0], [100, 0]]), np.array([[0, 0], [100, 900]]), np.array([[0, 0], [100, 1]])
    state = K.Bounds.fresh(x, away[0], 0)
    one = K.Bounds(state.cluster[:1].copy(), state.distance[:1].copy(), state.evaluated[:1].copy())
    assert one.reassign(x[:1], np.stack(away), 2) == 0 and one.cluster[0] == 0

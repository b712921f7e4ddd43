import random

from newsweave.operators import clusters as CL


def sequential(sets, threshold, fixed=()):
    leaders = [(name, set(s), 0) for name, s in fixed]
    out = {}
    for item in sorted(sets):
        mine = sets[item]
        best = None
        for name, other, kind in leaders:
            j = len(mine & other) / len(mine | other)
            if j >= threshold and (best is None or (-j, kind, name) < best):
                best = (-j, kind, name)
        if best is None:
            leaders.append((item, mine, 1))
            out[item] = (item, 1.0)
        else:
            out[item] = (best[2], round(-best[0], 9))
    return out


def rows(spark, sets):
    return spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "item long, entity long")


def test_leader_clusters_equal_the_loop(spark):
    rng = random.Random(5)
    for turn in range(2):
        sets = {i: {rng.randrange(9) for _ in range(rng.randrange(1, 6))} for i in range(80)}
        got = {r.item: (r.cluster_id, round(r.similarity, 9)) for r in CL.leader_clusters(rows(spark, sets)).collect()}
        assert got == sequential(sets, 0.6)


def test_existing_leaders_come_first(spark):
    sets = {1: {1, 2, 3}, 2: {1, 2}, 3: {7, 8}}
    known = {-5: {1, 2, 3, 4}}
    got = {r.item: r.cluster_id for r in CL.leader_clusters(rows(spark, sets), leaders=rows(spark, known)).collect()}
    assert got == {k: v[0] for k, v in sequential(sets, 0.6, known.items()).items()} == {1: -5, 2: 2, 3: 3}


def test_empty(spark):
    assert CL.leader_clusters(rows(spark, {1: {1}}).limit(0)).count() == 0

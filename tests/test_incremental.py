import os
import random
import shutil

import pytest
from pyspark.sql import functions as F
from test_clusters import sequential

from newsweave import queries_search as QS
from newsweave.operators import clusters as CL
from newsweave.operators import incremental as IN
from newsweave.operators import setjoin as SJ
from newsweave.plans.tables import MAX_PARTS, Tables
from newsweave.streaming import pipelines as ST

LAYOUTS = {"a": (("k",), 8), "b": (("k",), 4)}


def pairs(spark, values):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(values)], "k long, v string, at int")


def rows(df):
    return sorted((r.k, r.v) for r in df.collect())


def files(root, table):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{root}/data/{table}") for f in fs if f.endswith(".parquet")}


def test_tables_change_together(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), LAYOUTS)
    assert tables.read("a") is None
    with tables.batch("job", 0) as b:
        b.upsert("a", pairs(spark, [(k, f"old{k}") for k in range(50)]), "at")
        b.append("b", pairs(spark, [(1, "x")]))
    with pytest.raises(ZeroDivisionError), tables.batch("job", 1) as b:
        b.upsert("a", pairs(spark, [(1, "lost")]).withColumn("at", F.lit(999)), "at")
        assert (1, "lost") in rows(b.read("a")) and (1, "lost") not in rows(tables.read("a"))
        1 / 0
    assert rows(tables.read("a")) == sorted((k, f"old{k}") for k in range(50)) and not tables.committed("job", 1)
    before = files(tmp_path / "t", "a")
    updates = pairs(spark, [(3, "one"), (3, "two"), (99, "new")])
    touched = tables.buckets_of("a", updates)
    with tables.batch("job", 1) as b:
        b.upsert("a", updates.withColumn("at", F.col("at") + 1000), "at")
        b.remove("b", pairs(spark, [(1, "")]))
    want = sorted([(k, f"old{k}") for k in range(50) if k != 3] + [(3, "two"), (99, "new")])
    assert rows(tables.read("a")) == want and rows(tables.read("b")) == []
    kept = {f for f in before if not any(f"bucket_no={t}/" in f for t in touched)}
    assert 0 < len(kept) < len(before) and kept <= files(tmp_path / "t", "a")  # other buckets' files are untouched
    with tables.batch("job", 1) as b:  # repeated after its commit
        assert b.skipped
        b.append("b", pairs(spark, [(7, "twice")]))
    assert rows(tables.read("b")) == []


def test_a_commit_in_between_is_not_lost(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), LAYOUTS)
    with pytest.raises(RuntimeError, match="since this batch began"), tables.batch("slow", 0) as slow:
        slow.append("b", pairs(spark, [(1, "slow")]))
        with tables.batch("quick", 0) as quick:
            quick.append("b", pairs(spark, [(2, "quick")]))
    assert rows(tables.read("b")) == [(2, "quick")] and not tables.committed("slow", 0)
    with tables.batch("slow", 0) as slow:
        slow.append("b", pairs(spark, [(1, "slow")]))
    assert rows(tables.read("b")) == [(1, "slow"), (2, "quick")]


def test_many_batches_stay_few_files(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), {"b": (("k",), 2)})
    counts = []
    for n in range(MAX_PARTS + 8):
        with tables.batch("job", n) as b:
            b.append("b", pairs(spark, [(k, str(n)) for k in range(10 * n, 10 * n + 10)]))
        counts.append(len(files(tmp_path / "t", "b")))
    assert max(counts) <= 2 * 2 * (MAX_PARTS + 2) and tables.read("b").count() == 10 * (MAX_PARTS + 8)
    assert len(os.listdir(tmp_path / "t" / "snapshots")) <= 4  # two snapshots and their checksums


def test_small_update_does_not_exchange_the_table(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), LAYOUTS)
    with tables.batch("job", 0) as b:
        b.append("a", pairs(spark, [(k, "x") for k in range(100)]))
    plans = []
    with tables.batch("job", 1) as b:
        write = b._write

        def spy(name, out, replaced=()):
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            write(name, out, replaced)

        b._write = spy
        b.remove("a", pairs(spark, [(5, "")]))
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "Exchange hashpartitioning" not in plans[0]
    assert tables.read("a").count() == 99


def random_sets(seed, n, elements=9, first=0):
    rng = random.Random(seed)
    return {first + i: {rng.randrange(elements) for _ in range(rng.randrange(1, 6))} for i in range(n)}


def set_rows(spark, sets, name="item"):
    return spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], f"{name} long, entity long")


def looped(batches, threshold, newest_first):
    """The sequential loop over all batches, items of a batch in order."""
    leaders, out = [], {}
    for sets in batches:
        for item in sorted(sets, reverse=newest_first):
            if item in out:
                continue
            best = None
            for place, (name, other) in enumerate(leaders):
                j = len(sets[item] & other) / len(sets[item] | other)
                if j >= threshold and (best is None or j > best[0]):
                    best = (j, name)
            if best is None:
                leaders.append((item, sets[item]))
                out[item] = (item, 1.0)
            else:
                out[item] = (best[1], round(best[0], 9))
    return out


@pytest.mark.parametrize("newest_first", [False, True])
def test_batches_equal_the_loop(spark, tmp_path, newest_first):
    tables = IN.cluster_tables(spark, str(tmp_path / "c"), 4)
    batches = [random_sets(k, 50, 9 + k, 1000 * (k % 2) + 40 * k) for k in range(3)]
    for n, sets in enumerate(batches):
        with tables.batch("clusters", n) as b:
            IN.assign_batch(b, set_rows(spark, sets), newest_first=newest_first)
    got = {r.item: (r.cluster_id, round(r.similarity, 9)) for r in tables.read("assignments").collect()}
    assert got == looped(batches, 0.6, newest_first)


def test_backfill_in_descending_order(spark):
    sets = random_sets(4, 90)
    got = {r.item: (r.cluster_id, round(r.similarity, 9)) for r in CL.leader_clusters(set_rows(spark, sets), newest_first=True, at_most=60).collect()}
    assert got == looped([{i: sets[i] for i in sorted(sets)[-60:]}], 0.6, True)
    known = {5: {1, 2, 3}, 9: {1, 2, 3, 4}, 7: {1, 2, 3}}
    got = {r.item: r.cluster_id for r in CL.leader_clusters(set_rows(spark, {1: {1, 2, 3}, 2: {50}, 3: {50}}), 0.6, set_rows(spark, known), newest_first=True).collect()}
    assert got == {1: 7, 2: 3, 3: 3}
    assert {r.item: r.cluster_id for r in CL.leader_clusters(set_rows(spark, {1: {1, 2, 3}}), 0.6, set_rows(spark, known)).collect()} == {1: 5}


def test_a_batch_reads_only_the_buckets_it_probes(spark, tmp_path):
    root = tmp_path / "c"
    tables = IN.cluster_tables(spark, str(root))
    body = ST.assign_from_index(tables)
    body(set_rows(spark, {i: {10 * i, 10 * i + 1, 10 * i + 2} for i in range(200)}), 0)
    new = {900: {50, 51, 52, 53}, 901: {70, 71, 72}}
    order = tables.read("element_order")
    classes, _ = SJ.set_classes(set_rows(spark, new).withColumnRenamed("item", "id"))
    probed = set(tables.buckets_of("set_keys", SJ.join_keys(classes, order, 0.6, equal=True)))
    assert len(probed) < IN.BUCKETS
    for path in files(root, "set_keys"):  # take all other buckets away: the batch must not need them
        if int(path.split("bucket_no=")[1].split("/")[0]) not in probed:
            os.remove(path)
            shutil.rmtree(os.path.dirname(path))
    body(set_rows(spark, new), 1)
    body(set_rows(spark, {902: {1}}), 1)  # the same batch again
    got = {r.item: r.cluster_id for r in tables.read("assignments").where("item >= 900").collect()}
    assert got == {900: 5, 901: 7}


def brute_groups(sets, days, ratio, within):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            close = within is None or (days[a] is not None and days[b] is not None and abs(days[a] - days[b]) <= within)
            if a < b and close and len(sets[a] & sets[b]) >= ratio * len(sets[a] | sets[b]) - 1e-12:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    every = {i: root(i) for i in sets}
    return {i: g for i, g in every.items() if list(every.values()).count(g) > 1}


def dated(spark, days):
    df = spark.createDataFrame([(i, d) for i, d in days.items()], "cluster_id long, d int")
    return df.select("cluster_id", F.expr("date_add(DATE'2024-01-01', d)").alias("latest"))


@pytest.mark.parametrize("within", [None, 0, 10])
def test_merge_groups_with_dates_at_once_and_by_batch(spark, tmp_path, within):
    rng = random.Random(11)
    sets = random_sets(6, 120, 14)
    days = {i: None if rng.random() < 0.05 else rng.randrange(12 if not within else 120) for i in sets}
    want = brute_groups(sets, days, 0.6, within)
    latest = None if within is None else dated(spark, days)
    full = CL.merge_groups(set_rows(spark, sets, "id"), 0.6, latest, within or 0)
    assert {r.cluster_id: r.group_id for r in full.collect()} == want and len(set(want.values())) > 3
    if within == 0:
        return
    tables = IN.merge_tables(spark, str(tmp_path / "m"), 4)
    for n in range(3):
        part = {i: s for i, s in sets.items() if i % 3 == n or (n == 2 and i == 0)}  # one cluster is given again
        with tables.batch("merges", n) as b:
            near = latest and latest.where(F.col("cluster_id").isin(list(part)))
            touched = {r.cluster_id: r.group_id for r in IN.merge_batch(b, set_rows(spark, part, "cluster_id"), 0.6, near, within or 0).collect()}
            assert set(part) <= set(touched)
    got = {r.cluster_id: r.group_id for r in tables.read("groups").collect()}
    assert {i: g for i, g in got.items() if list(got.values()).count(g) > 1} == want and set(got) == set(sets)


def test_cross_pairs_find_every_similar_pair(spark):
    left, right = random_sets(1, 60, 12), random_sets(2, 60, 12, 500)
    left[60], right[700] = set(range(40)), set(range(2, 40))  # larger than SIZED
    for threshold in (0.3, 0.5, 0.6, 0.9, 1.0):
        got = {(r.left_id, r.right_id) for r in SJ.jaccard_pairs(set_rows(spark, left, "id"), set_rows(spark, right, "id"), threshold).collect()}
        assert got == {(a, b) for a, x in left.items() for b, y in right.items() if len(x & y) / len(x | y) >= threshold}


def test_registered_batches_equal_the_loop(spark, sf_dir):
    from newsweave.sources import bindings as B

    sets = {}
    for r in B.primary_sets(spark, sf_dir).collect():
        sets.setdefault(r.item, set()).add(r.entity)
    got = {r.item: (r.cluster_id, round(r.similarity, 9)) for r in QS.clusters_by_batch(spark, sf_dir).collect()}
    assert got == looped([{i: s for i, s in sets.items() if i % 3 == k} for k in range(3)], 0.6, False)
    old = {i: s for i, s in sets.items() if i % 10 == 0}
    new = {i: s for i, s in sets.items() if i % 10}
    found = {r.item: r.cluster_id for r in QS.backfilled_clusters(spark, sf_dir).collect()}
    want = sequential({-i: s for i, s in new.items()}, 0.6, [(-i, s) for i, s in old.items()])
    assert found == {-i: -c for i, (c, _) in want.items()}

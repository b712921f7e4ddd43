import random

import numpy as np
from pyspark.sql import functions as F

from newsweave.operators import aliases as AL
from newsweave.operators import dedup as DD
from newsweave.operators import matching as MA
from newsweave.operators import routing as RO
from newsweave.operators import vectors as VE
from newsweave.plans.graph import connected_components


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (1, 2)], "src long, dst long")
    assert {r.node: r.label for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_cosine_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    got = {(r.source_id, r.target_id): r.rank for r in VE.cosine_top_k(df.where("id < 20"), df, 5, 0.2, part_rows=16).collect()}
    want = {}
    for i in range(20):
        if i == 7:
            continue
        s = [(-(v[i] @ v[j]) / np.linalg.norm(v[i]) / np.linalg.norm(v[j]), j) for j in range(60) if j not in (i, 7)]
        want |= {(i, j): k + 1 for k, (c, j) in enumerate(sorted(s)[:5]) if -c >= 0.2}
    assert got == want


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, 1, [3.0, 0.0]), (1, 1, [0.0, 4.0]), (1, 0, [9.0, 9.0])], "id long, mask int, vector array<double>")
    assert [round(x, 6) for x in VE.mean_pool(df).first()["embedding"]] == [0.6, 0.8]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1, 10), (2, "b", 1, None)], "k long, v string, at long, c long")
    new = spark.createDataFrame([(1, "x", 2, 99), (3, "c", 1, 7)], "k long, v string, at long, c long")
    once = DD.upsert(old, new, ["k"], "at", kept=("c",))
    twice = DD.upsert(once, new, ["k"], "at", kept=("c",))
    rows = lambda d: sorted(tuple(r) for r in d.select("k", "v", "at", "c").collect())
    assert rows(once) == rows(twice) == [(1, "x", 2, 10), (2, "b", 1, None), (3, "c", 1, 7)]


def test_alias_upsert(spark):
    kind = "canonical string, alias string, type string, confidence double, source string, status string, approved_by string"
    now = spark.createDataFrame([("a", "b", "PERSON", 0.5, "s", "REJECTED", None)], kind)
    new = spark.createDataFrame([("a", "b", "PERSON", 0.9, "t", "APPROVED", "x"), ("c", "c", "PERSON", 1.0, "t", None, None), ("d", "e", "PERSON", 1.0, "t", None, None)], kind)
    bad = spark.createDataFrame([("d", "e", "PERSON", 1)], "name_lo string, name_hi string, type string, persistence_level long")
    once = AL.upsert_aliases(now, new, bad)
    assert [tuple(r) for r in once.collect()] == [("a", "b", "PERSON", 0.9, "t", "APPROVED", "x")]
    assert [tuple(r) for r in AL.upsert_aliases(once, new, bad).collect()] == [tuple(r) for r in once.collect()]


def test_alias_phrases(spark):
    texts = ["Microsoft Corporation (formerly Micro-Soft) grew", "Meta, which rebranded as Facebook.", "Tim Cook, CEO of Apple Inc.", "Nothing here."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.canonical, r.alias) for r in AL.alias_pairs(df).collect()}
    assert (0, "Microsoft Corporation", "Micro-Soft") in got and not [g for g in got if g[0] == 3]


def test_greedy_similarity_equals_the_loop(spark):
    rng = random.Random(3)
    levels = list(MA.WEIGHTS)
    edges, sizes, want = [], [], {}
    for pair in range(30):
        s, t = [rng.choice(levels) for _ in range(rng.randrange(1, 6))], [rng.choice(levels) for _ in range(rng.randrange(1, 6))]
        hit = {(i, j) for i in range(len(s)) for j in range(len(t)) if rng.random() < 0.4}
        edges += [(pair, pair + 100, "PERSON", i, j, s[i], t[j]) for i, j in hit]
        sizes.append((pair, pair + 100, "PERSON", len(s), len(t)))
        used, total = set(), 0.0
        for i in range(len(s)):
            for j in range(len(t)):
                if (i, j) in hit and j not in used:
                    used.add(j)
                    total += (MA.WEIGHTS[s[i]] + MA.WEIGHTS[t[j]]) / 2
                    break
        want[pair] = round(total / ((len(s) + len(t)) / 2), 9)
    e = spark.createDataFrame(edges, "source_id long, target_id long, type string, s_rank int, t_rank int, s_importance string, t_importance string")
    n = spark.createDataFrame(sizes, "source_id long, target_id long, type string, n_source long, n_target long")
    assert {r.source_id: round(r.score, 9) for r in MA.greedy_similarity(e, n).collect()} == want


def test_people_and_records(spark):
    raw = '{"Europe": {"Italy": {"Tuscany": ["Ann, B, Pisa, Italy, tz, @a", "Bo, C, Lucca", "short, x"]}}}'
    got = {(r.city, r.person) for r in RO.people(spark.createDataFrame([(raw,)], "places string")).collect()}
    assert got == {("Pisa", "Ann"), ("Lucca", "Bo")}
    v = spark.createDataFrame([(1, "summary", "<think>x</think>S"), (1, "sources_quality", "3"), (2, "tiny_summary", "t")], "article_id long, question string, response string")
    rows = {r.article_id: r for r in RO.analysis_record(v).collect()}
    assert rows[1].summary == "S" and rows[1].quality == 3 and rows[2].tiny_summary == "" and rows[2].source_type == "none"


def test_mixed_draw(spark):
    q = spark.range(40).select(F.col("id").cast("string").alias("normalized_url"), F.col("id").alias("seen_at"))
    got = [r.normalized_url for r in DD.mixed_draw(q, 20).collect()]
    assert len(set(got)) == 20 and {"39", "38", "0", "1"} <= set(got)

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from newsweave.functions import names as N
from newsweave.functions import spelling as S

WORDS = "Acme Global Systems Paris North River Anna Lee Corp Corporation Falcon Jet Model 9 X1 GS IBM Über Straße 東京 été's États-Unis v2 v3 Project Projekt".split()


def random_pairs(n, seed=5):
    rng = random.Random(seed)

    def edited(x):
        x = list(x)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randrange(2)] = rng.choice(["", "s", "a", " ", "é", "1"])
        return "".join(x)

    for _ in range(n):
        a = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 5)))
        yield a, edited(a) if rng.random() < 0.7 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 5)))


def matrices(pairs):
    a, b = (pd.Series(x, dtype=object) for x in zip(*pairs))
    return (*S.code_points(a), *S.code_points(b))


def test_measures_equal_the_plain_functions():
    pairs = [*random_pairs(30_000), ("", ""), ("a", ""), ("", "b"), ("x" * 63, "x" * 64), ("ab" * 40, "ba" * 45), ("x" * 64, "y" * 3), ("a", "b"), ("a", "a")]
    m = matrices(pairs)
    assert S.edit_distances(*m).tolist() == [N.edit_distance(a, b) for a, b in pairs]
    assert np.allclose(S.jaro_winkler_similarities(*m), [N.jaro_winkler(a, b) for a, b in pairs], atol=1e-12)
    start = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in pairs]
    assert S.common_start(*m).tolist() == start


def test_bits_and_rows_agree():
    pairs = list(random_pairs(3000, 9))
    a, la, b, lb = matrices(pairs)
    keep = (la > 0) & (la <= S.WORD)
    assert (S._by_bits(a[keep], la[keep], b[keep], lb[keep]) == S._by_rows(a[keep], la[keep], b[keep], lb[keep])).all()


def test_columns_equal_the_plain_rules(spark):
    kinds = ["PERSON", "ORGANIZATION", "LOCATION", "PRODUCT", "EVENT"]
    raw = list(dict.fromkeys((a, b, kinds[k % 5]) for k, (a, b) in enumerate(random_pairs(6000, 2))))
    raw += [("IBM", "International Business Machines", "ORGANIZATION"), ("GS", "Goldman Sachs", "ORGANIZATION"), ("", "x", "ORGANIZATION"), ("Falcon 9", "Falcon Heavy", "PRODUCT"), ("Smiths", "Smith", "PERSON")]
    rows = [(N.normal_form(a, k), N.normal_form(b, k), a, b, k) for a, b, k in raw]
    df = spark.createDataFrame(rows, "a string, b string, raw_a string, raw_b string, kind string").repartition(4)
    got = df.withColumn("m", N.fuzzy_names(*(F.col(c) for c in df.columns))).collect()
    wrong = [r for r in got if r.m != N.fuzzy_match(*r[:5])]
    assert not wrong and 500 < sum(r.m for r in got) < len(got)
    keys = df.select("a", "kind", N.edit_key_columns(F.col("a"), F.col("kind"), True).alias("l"), N.edit_key_columns(F.col("a"), F.col("kind"), False).alias("r")).where("a <> ''")
    for r in keys.limit(800).collect():
        assert sorted(r.l) == N.edit_keys(r.a, r.kind, True) and sorted(r.r) == N.edit_keys(r.a, r.kind, False)


def test_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a")], "a string, b string")
    assert [r.s for r in df.select(N.jaro_winkler_similarity("a", "b").alias("s")).collect()] == [None, None, 1.0]
    names = spark.createDataFrame([(None, "PERSON"), ("Ann", None), ("Ann", None), ("Defense Programs", "ORGANIZATION")], "n string, k string")
    assert [r.f for r in names.select(N.normalize_name("n", "k").alias("f")).collect()] == [None, "ann", "ann", N.normal_form("Defense Programs", "ORGANIZATION")]

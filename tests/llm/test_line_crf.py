import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import edges, empty  # noqa: F401

from newsweave.llm import line_crf as L
from newsweave.llm import queries
from newsweave.llm.textscan import text_slices

TEXTS = ["", None, "one", "\n", "a b\nA!! B!!\n\nx | y | z", "same line\nother\nsame line\n", "w w w w w w", "abc### de***\n1234 5", "Élan été\n\n", "a b c d a b c e"]


def table_of(texts):
    (_, _, data, offsets), *rest = text_slices(pa.array(texts, pa.string()), 1 << 30)
    assert not rest
    return L.measures(data, offsets)


def random_chain(seed=3):
    rng = np.random.default_rng(seed)
    chain = L.Chain()
    chain.weight[:] = rng.normal(0, 1, L.FEATURES)
    chain.pair[:] = rng.normal(0, 1, (2, 2))
    return chain


def brute_marginals(chain, x):
    """All label sequences of one text."""
    z, good = 0.0, np.zeros(len(x))
    for path in itertools.product((0, 1), repeat=len(x)):
        p = math.exp(sum(y * float(f @ chain.weight) for y, f in zip(path, x)) + sum(chain.pair[a, b] for a, b in zip(path, path[1:])))
        z += p
        good += p * np.array(path)
    return good / z, math.log(z)


def test_lines_are_those_of_split():
    _, length, first = table_of(TEXTS)
    want = [len(x) for t in TEXTS for x in (t or "").split("\n")]
    assert length.tolist() == want
    assert np.diff(first).tolist() == [len((t or "").split("\n")) for t in TEXTS]


def plain_shares(text):
    """The shares of each line by plain Python, in the order of ``measures``."""
    low = [[w.lower() for w in x.split()] for x in text.split("\n")]
    flat = [w for x in low for w in x]
    three = [tuple(flat[k : k + 3]) for k in range(len(flat) - 2)]
    hit = {k + d for k, t in enumerate(three) if three.count(t) > 1 for d in range(3)}
    out, seen, at = [], set(), 0
    for line, words in zip(text.split("\n"), low):
        n, raw = max(len(words), 1), line.split()
        marks = set(L.SYMBOLS.decode()) | set("!|")
        ascii_letters = [c for c in line if c.isascii() and c.isalpha()]
        out.append([
            sum(c.isupper() for c in ascii_letters) / max(1, len(ascii_letters)),
            sum(c in L.SYMBOLS.decode() for c in line) / max(1, len(line)),
            min(line.count("!") / n, 2),
            line.count("|") / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            1 - len(set(words)) / n if words else 0,
            sum(at + k in hit for k in range(len(words))) / n,
            sum(w[-1] in marks and w[0] not in marks for w in raw) / n,
            sum(sum(c.isascii() and c.isupper() for c in w) > 1 and not any(c.isascii() and c.islower() for c in w) for w in raw) / n,
            bool(words) and line in seen,
        ])
        seen.add(line)
        at += len(words)
    return out


def test_measures_match_plain_python():
    texts = [t for t in TEXTS if t is not None] + ["THE Big!! ones | a a a\nTHE Big!! ones | a a a", "x y z\nx y\nz x y z"]
    table, _, first = table_of(texts)
    for d, t in enumerate(texts):
        own = table[first[d] : first[d + 1]]
        want = np.array(plain_shares(t), float)
        assert np.allclose(own[:, : L.SHARES], want[:, : L.SHARES])
        assert np.allclose(own[:, 2 * L.SHARES + 5], want[:, L.SHARES])


def test_neighbours_stay_inside_a_text():
    table, _, first = table_of(TEXTS)
    x, m = L.features(table, first), L.MEASURES
    for d in range(len(TEXTS)):
        for k in range(first[d], first[d + 1]):
            before = table[k - 1] if k > first[d] else np.zeros(m)
            after = table[k + 1] if k + 1 < first[d + 1] else np.zeros(m)
            assert (x[k] == np.concatenate([table[k], before, after, [1, k == first[d]]])).all()


def test_marginals_match_all_label_sequences():
    chain = random_chain()
    table, _, first = table_of(TEXTS)
    got, x = chain.marginals(table, first), L.features(table, first)
    _, _, total = chain.passes(x @ chain.weight, first)
    for d in range(len(TEXTS)):
        want, z = brute_marginals(chain, x[first[d] : first[d + 1]])
        assert np.allclose(got[first[d] : first[d + 1]], want) and total[d] == pytest.approx(z)


def test_gradient_matches_differences():
    chain = random_chain(5)
    table, _, first = table_of(TEXTS)
    x, rng = L.features(table, first), np.random.default_rng(2)
    good, share = rng.integers(0, 2, len(x)).astype(float), rng.random(len(first) - 1)
    value, slope, pairs = chain.gradient(x, first, good, share)

    def path_value():
        total = 0.0
        for d in range(len(first) - 1):
            own, y = x[first[d] : first[d + 1]], good[first[d] : first[d + 1]].astype(int)
            gold = float(y @ (own @ chain.weight)) + sum(chain.pair[a, b] for a, b in zip(y, y[1:]))
            total += share[d] * (gold - brute_marginals(chain, own)[1])
        return total

    assert value == pytest.approx(path_value())
    for w, g in ((chain.weight, slope), (chain.pair, pairs)):
        for k in np.ndindex(w.shape):
            w[k] += 1e-5
            up = path_value()
            w[k] -= 2e-5
            down = path_value()
            w[k] += 1e-5
            assert g[k] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_long_chain_is_stable():
    chain = random_chain(9)
    table, _, first = table_of(["A!! B!!\n" * 20_000 + "x"])
    got = chain.marginals(table, first)
    assert len(got) == 20_001 and np.isfinite(got).all() and (got >= 0).all() and (got <= 1).all()


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op13_crf_quality(spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert sum(1 for a, b in held if b == 1 and a == 0) <= 0.02 * len(held)


def test_edge_rows(spark, edges, empty):  # noqa: F811
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (999999, 1), (100, 1), (101, 1), (102, 0)], "doc_id long, quality int")
    rows = L.scored(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id == 7} and len({r.score for r in rows if r.doc_id == 7}) == 1
    assert len({round(r.score, 9) for r in rows if r.doc_id in (1, 2)}) == 1  # null and empty alike
    assert L.scored(empty, labels).count() == 0
    untrained = L.scored(edges, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in untrained] == [(0.5, 1)]


def test_labels_language_and_source_are_no_inputs(spark, edges):  # noqa: F811
    labels = spark.createDataFrame([(100 + k, int(k % 8 < 4)) for k in range(40)], "doc_id long, quality int")
    one = {(r.doc_id, r.score) for r in L.scored(edges, labels).collect()}
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert one == {(r.doc_id, r.score) for r in L.scored(edges.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), other).collect()}

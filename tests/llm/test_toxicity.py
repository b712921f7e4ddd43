import math
import os
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import edges, empty  # noqa: F401

from newsweave.llm import toxicity as T
from newsweave.llm.textscan import text_slices


def rows_of(texts):
    (_, _, data, offsets), *rest = text_slices(pa.array(texts), 1 << 30)
    assert not rest
    return T.word_rows(data, offsets)


def small_corpus(n=300):
    rng = np.random.default_rng(5)
    texts, target = [], []
    for k in range(n):
        words = [f"w{rng.integers(200)}" for _ in range(int(rng.integers(0, 40)))]
        if bad := k % 5 == 0:
            words.insert(int(rng.integers(0, len(words) + 1)), "vile scum"[: 4 + 5 * int(k % 2)])
        texts.append(" ".join(words))
        target.append(float(bad))
    return texts, np.array(target, np.float32)


@pytest.fixture(scope="module")
def model():
    texts, target = small_corpus()
    cnn = T.TextCnn()
    return cnn, cnn.fit(*rows_of(texts), target), texts, target


def test_forward_pass_matches_brute_force(model):
    cnn, _, texts, _ = model
    texts = [*texts[:40], "", "vile", "a vile scum b", None]
    rows, bounds = rows_of(texts)
    got = cnn.scores(rows, bounds)
    for d in range(len(texts)):
        own = [cnn.embed[r].astype(float) for r in rows[bounds[d] : bounds[d + 1]]]
        z = float(cnn.bias)
        for j, w in enumerate(T.WIDTHS):
            for f in range(T.FILTERS):
                best = max(cnn.shift[j][f] + sum(float(v @ cnn.conv[j][k][:, f]) for k, v in enumerate(own[p : p + w])) for p in range(len(own) - w + 1))
                z += max(best, 0) * float(cnn.out[j * T.FILTERS + f])
        assert got[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_it_learns_and_trains_its_start_values(model):
    cnn, outside, texts, target = model
    scores = cnn.scores(*rows_of(texts))
    assert np.mean((scores > 0.5) == (target > 0)) > 0.95 and np.mean((outside > 0.5) == (target > 0)) > 0.9
    rows, bounds = rows_of(texts)
    parts = [np.unique(rows[bounds[d] : bounds[d + 1]]) for d in range(len(target))]
    given, _ = T.word_evidence(parts, np.arange(len(target)), target, np.ones(len(target), bool))
    moved = np.abs(cnn.embed[:, : T.GIVEN] - given).max(axis=1) > 1e-3
    assert moved[np.unique(rows)].any() and not cnn.embed[0].any()


def test_two_starts_give_equal_scores():
    code = textwrap.dedent("""
        import sys; sys.path[:0] = [%r, %r]
        from test_toxicity import T, rows_of, small_corpus
        texts, target = small_corpus(120)
        cnn = T.TextCnn(); outside = cnn.fit(*rows_of(texts), target)
        print(cnn.scores(*rows_of(texts)).tobytes().hex(), outside.tobytes().hex())
    """ % (str(Path(T.__file__).resolve().parents[2]), str(Path(__file__).parent)))
    runs = [subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONHASHSEED": seed}, capture_output=True, text=True, check=True).stdout for seed in ("1", "2")]
    assert runs[0] == runs[1] and len(runs[0]) > 100


def test_ties_repeats_and_empty_texts(spark, edges):  # noqa: F811
    texts, target = small_corpus()
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(y)) for k, y in enumerate(target)] + [(3, None), (None, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    again = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id = 8").withColumn("text", F.lit(None).cast("string")))
    clashing = again.withColumns({c: F.lit(9) for c in ("score", "toxic", "held_out", "predicted", "label")})
    rows = T.scored(clashing, labels.withColumn("text", F.lit("x"))).collect()
    assert len(rows) == len(texts) + 51
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(max(s) - min(s) < 1e-5 for i, s in by_id.items() if i != 8) and all(r.predicted == (r.score >= T.PREDICT_AT) for r in rows)
    alone = {r.doc_id: r.score for k in range(6) for r in T.scored(clashing, labels).where(f"doc_id = {k}").collect()}
    assert all(abs(s - alone[k]) < 1e-5 for k in alone for s in by_id[k])
    empty_scores = {r.score for r in T.scored(edges.where("doc_id <= 3"), labels).collect()}
    assert max(empty_scores) - min(empty_scores) < 1e-5

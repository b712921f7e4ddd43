import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import edges, empty  # noqa: F401

from newsweave.llm import periodic_runs as P
from newsweave.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Every lag, word by word; a stretch is kept if no smaller lag fits it as a whole."""
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            b = i
            while i < n and w[i] == w[i - q]:
                i += 1
            s, length = b - q, i - b + q
            if length >= max(24, 3 * q) and not any(all(w[k] == w[k - p] for k in range(s + p, s + length)) for p in range(1, q)):
                found.append((s, length, q))
    return sorted(found)


def altered(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    w = altered(doc_id, WORD.findall(text or ""))
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


def sequences():
    rng = random.Random(3)
    for _ in range(400):
        w, kinds = [], rng.choice([1, 2, 3, 8, 60])
        while len(w) < rng.randrange(20, 260):
            base = [rng.randrange(kinds) for _ in range(rng.randrange(1, 40))]
            w += (base * rng.randrange(1, 9))[: rng.randrange(1, 160)]
            if rng.random() < 0.4:
                w.append(rng.randrange(100))
        yield w
    yield from ([0] * 500, [0, 1] * 12, [0] * 23, [0] * 24, list(range(8)) * 3, list(range(9)) * 3, list(range(9)) * 2 + list(range(8)), [])
    fib = [0]
    other = [0, 1]
    while len(other) < 400:
        fib, other = other, other + fib
    yield other


def test_runs_match_every_lag():
    n = 0
    for w in sequences():
        want = brute_runs(w)
        n += len(want)
        assert P.runs_of(np.array(w, np.int64)) == want
    assert n > 300


def test_long_periodic_sequences_take_few_steps():
    for q in (1, 2, 7, 100):
        w = np.tile(np.arange(q), 200_000 // q)
        at, lag = P.earlier_occurrences(w)
        assert len(at) <= len(w) and P.runs_of(w) == [(0, len(w), q)]
    line = list(range(30))
    w = np.array([x for k in range(3000) for x in [*line, 1000 + k]])  # a line met 3,000 times, never periodic
    assert len(P.earlier_occurrences(w)[0]) < 40_000 * 3 and P.runs_of(w) == []


def test_quick_filter_never_hides_a_repeat():
    from newsweave.llm.textscan import text_slices
    import pyarrow as pa

    texts = [" ".join(map(str, w)) for w in sequences()]
    for _, _, data, offsets in text_slices(pa.array(texts)):
        busy = P._repeats_context(data, offsets)
        for d, w in enumerate(sequences()):
            assert busy[d] or not brute_runs(w)


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_matches_brute_force(spark, size):
    folder = f"/root/testdata/{size}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_periodic_runs(spark, folder).collect()
    assert len(rows) == len(texts)
    short = 0
    for r in rows:
        if len(texts[r.doc_id] or "") < 12_000:
            short += 1
            got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
            assert got == digest(r.doc_id, texts[r.doc_id])
    assert short > 150 and any(r.n_runs for r in rows)


def test_edge_rows(spark, edges, empty):  # noqa: F811
    rows = {(r.doc_id, r.n_runs, r.collapsed_sha256): r for r in P.run_digest(P.periodic_runs(edges, P.repeat_tail)).collect()}
    want = {(r.doc_id, *digest(r.doc_id, r.text)) for r in edges.where(F.length("text") < 10_000).collect()}
    want |= {(r.doc_id, *digest(r.doc_id, None)) for r in edges.where("text IS NULL").collect()}
    got = {(k[0], r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for k, r in rows.items() if k[0] != 500}
    assert got == want
    (long,) = [r for k, r in rows.items() if k[0] == 500]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 30000, 1)
    assert P.run_digest(P.periodic_runs(empty)).count() == 0
    plain = P.periodic_runs(edges.where("doc_id = 500")).first()
    assert plain.collapsed == "long" and plain.n_words == 30000

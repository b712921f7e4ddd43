import math
import zlib
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pytest
from test_llm import crc, edge_rows, edges, empty, token_ids, words  # noqa: F401

from newsweave.llm import attention_lm as A
from newsweave.llm import queries, token_files

TOKENIZER = queries.tokenizer_file()


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def brute_scores(rows, weights):
    """Every word by itself, in 64-bit numbers and plain loops; ``weights`` are those that training gave."""
    ids_of = dict(zip(sorted({w for _, t in rows for w in words(t)}), token_ids([" " + w for w in sorted({w for _, t in rows for w in words(t)})]), strict=True))
    size, end = 50257, 50256
    train = Counter(w for i, t in rows if not held(i) for w in words(t))
    texts = sum(not held(i) for i, _ in rows)
    first, last, inner = (np.zeros(size) for _ in range(3))
    for w, n in train.items():
        ids = ids_of[w]
        first[ids[0]] += n
        last[ids[-1]] += n
        for k in ids[1:]:
            inner[k] += n
    first[end] += texts
    last[end] += texts
    lead, tail = A._dealt(first), A._dealt(last)
    mass, number = np.zeros(A.CLASSES), np.zeros(A.CLASSES)
    for k in range(size):
        mass[lead[k]] += first[k]
        number[lead[k]] += 1
    escape = np.ones(A.CLASSES)
    for w, n in train.items():
        escape[lead[ids_of[w][0]]] += n == 1
    even = (mass + 1) / (mass.sum() + A.CLASSES)
    total_words, total_inner = first.sum() + 1, inner.sum() + 1
    stop = math.log10(total_words / (total_words + total_inner))

    def share(ids, n):
        c = lead[ids[0]]
        spelt = math.log10((first[ids[0]] + 1) / (mass[c] + number[c])) + stop
        for k in ids[1:]:
            spelt += math.log10((inner[k] + 1) / (inner.sum() + size) * total_inner / (total_words + total_inner))
        whole = mass[c] + escape[c]
        return math.log10(n / whole + escape[c] / whole * 10 ** max(spelt, -300)) if n else math.log10(escape[c] / whole) + spelt

    lm = A.AttentionLm().load(weights)
    W = {n: np.asarray(getattr(lm, n), np.float64) for n in lm.NAMES}
    scores = []
    for _, t in rows:
        tokens = [*((ids_of[w], train[w]) for w in words(t)), ([end], texts)]
        score = 0.0
        for p, (ids, n) in enumerate(tokens):
            begin = p // A.STRIDE * A.STRIDE - (A.WINDOW - A.STRIDE)
            x = []
            for j, at in enumerate(range(begin, p + 1)):
                a, b = (lead[tokens[at - 1][0][0]], tail[tokens[at - 1][0][-1]]) if at >= 1 else (A.CLASSES, A.CLASSES)
                x.append(W["lead"][a] + W["last"][b] + W["place"][j])
            x = np.array(x)
            own = x[-1]
            weight = softmax((x @ W["key"]) @ (own @ W["query"]) / math.sqrt(A.SIZE))
            h = np.maximum(np.concatenate([own, weight @ (x @ W["value"])]) @ W["hidden"] + W["bend"], 0)
            c = lead[ids[0]]
            g, m = divmod(c, A.MEMBERS)
            p_class = softmax(h @ W["group"] + W["group_bias"])[g] * softmax(h @ W["member"][g] + W["member_bias"][g])[m]
            score += math.log10((1 - lm.mix) * p_class + lm.mix * even[c]) + share(ids, n)
        scores.append(score)
    return scores


def test_scores_match_brute_force(spark, edges, empty):  # noqa: F811
    rows = [r for r in edge_rows() if r[0] is not None and r[0] not in (7, 500)] + [(600, "rare wörd " * 3 + "unseenword日本 end")]
    given = []
    fit = A.fit
    with mock.patch.object(A, "fit", lambda *a: given.append(fit(*a)) or given[0]):
        got = {r.doc_id: r for r in A.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), TOKENIZER).collect()}
    train = Counter()
    for i, t in rows:
        if not held(i):
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    for (i, t), score in zip(rows, brute_scores(rows, given[0]), strict=True):
        tokens = [*words(t), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(train[w] > 0 for w in tokens), n, held(i))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-4)
    assert A.scored(empty, TOKENIZER).count() == 0
    assert A.scored(edges, TOKENIZER).count() == len(edge_rows())


def test_the_order_of_words_matters(spark):
    cycle = [f"{a}{b}" for a in ("red", "sun", "old") for b in ("ly", "er", "ing", "ed")]
    rows = [(k, " ".join(cycle[(k + j) % 12] for j in range(60))) for k in range(400)]
    shuffled = " ".join(np.random.default_rng(1).permutation([cycle[j % 12] for j in range(60)]))
    rows += [(1000, " ".join(cycle[j % 12] for j in range(60))), (1001, shuffled)]
    with mock.patch.object(A, "BATCH", 16):
        got = {r.doc_id: r for r in A.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), TOKENIZER).collect()}
    assert got[1000].base_score == pytest.approx(got[1001].base_score) and got[1000].score > got[1001].score + 5


def test_a_word_of_more_than_65535_ids(spark):
    rows = [(k, "some plain words of text " * 40) for k in range(1, 6)] + [(9, "before " + "a1" * 40_000 + " after it"), (10, "words after it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in A.scored(df, TOKENIZER).collect()}
    assert [got[9].n_tokens, got[10].n_tokens] == [5, 4] and got[9].score < got[10].score < 0
    folder = token_files.fresh_folder(spark, "t")
    token_files.write_token_files(df, folder, TOKENIZER, 0)
    read = {r.doc_id: r for r in token_files.read_token_files(spark, folder).collect()}
    for (i, _), ids in zip(rows, token_ids([t for _, t in rows]), strict=True):
        assert (read[i].n_tokens, read[i].ids_crc32) == (len(ids) + 1, crc([*ids, 0]))
    assert read[9].n_tokens > 1 << 16


def test_attention_is_causal():
    lm = A.AttentionLm()
    rng = np.random.default_rng(0)
    x, y = (rng.integers(0, A.CLASSES, (3, A.WINDOW)) for _ in range(2))
    before, _ = lm.forward(x, y, A.WINDOW)
    x2, y2 = x.copy(), y.copy()
    x2[:, 20:], y2[:, 20:] = (x[:, 20:] + 1) % A.CLASSES, (y[:, 20:] + 1) % A.CLASSES
    after, _ = lm.forward(x2, y2, A.WINDOW)
    shape = (3, A.WINDOW, -1)
    assert np.allclose(before.reshape(shape)[:, :20], after.reshape(shape)[:, :20], atol=1e-5)
    assert not np.allclose(before.reshape(shape)[:, 20:], after.reshape(shape)[:, 20:], atol=1e-3)


def test_class_probabilities_sum_to_one():
    lm = A.AttentionLm(9)
    h = np.abs(np.random.default_rng(1).normal(size=(1, A.HIDDEN))).astype(np.float32)
    p, _ = lm.class_probability(np.repeat(h, A.CLASSES, axis=0), np.arange(A.CLASSES))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_gradient_points_downhill():
    rng = np.random.default_rng(2)
    x, y, t = (rng.integers(0, A.CLASSES, (4, A.WINDOW)) for _ in range(3))
    lm = A.AttentionLm()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in lm.weights()]
    counted = np.ones(t.shape, bool)
    losses = [-np.log(lm.train_step(x, y, t, counted, moments, k + 1)).mean() for k in range(80)]
    assert losses[-1] < 0.6 * losses[0]


@pytest.mark.parametrize("name", A.AttentionLm.NAMES)
def test_gradient_equals_differences(name):
    rng = np.random.default_rng(3)
    x, y, t = (rng.integers(0, A.CLASSES, (2, A.WINDOW)) for _ in range(3))
    counted = rng.random(t.shape) < 0.7

    def loss(lm):
        h, _ = lm.forward(x, y, A.WINDOW)
        return -np.log(lm.class_probability(h, t.reshape(-1))[0].astype(np.float64))[counted.reshape(-1)].mean()

    lm = A.AttentionLm()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in lm.weights()]
    A.AttentionLm().train_step(x, y, t, counted, moments, 1)
    slope = moments[A.AttentionLm.NAMES.index(name)][0] * 10  # the first moment after one step
    at = np.unravel_index(np.argmax(np.abs(slope)), slope.shape)
    w, step = getattr(lm, name), 2e-3
    w[at] += step
    up = loss(lm)
    w[at] -= 2 * step
    assert (up - loss(lm)) / (2 * step) == pytest.approx(slope[at], rel=0.05, abs=5e-4)


def test_uncounted_places_teach_nothing():
    rng = np.random.default_rng(2)
    x, y, t = (rng.integers(0, A.CLASSES, (4, A.WINDOW)) for _ in range(3))
    counted = rng.random(t.shape) < 0.5
    flats = []
    for goal in (t, np.where(counted, t, (t + 7) % A.CLASSES)):
        lm = A.AttentionLm()
        lm.train_step(x, y, goal, counted, [(np.zeros_like(w), np.zeros_like(w)) for w in lm.weights()], 1)
        flats.append(lm.flat())
    assert np.allclose(*flats, atol=1e-6)


def test_every_token_is_in_one_window():
    bounds = np.array([0, 1, 5, 29, 53, 110, 111])
    stream = A.Stream(np.zeros(111, np.int64), bounds, np.arange(111) % 50, np.arange(111) % 50, None, None)
    for stride in (A.STRIDE, A.WINDOW):
        start, stop, text = stream.windows(stride)
        assert np.concatenate([np.arange(a, b) for a, b in zip(start, stop, strict=True)]).tolist() == list(range(111))
        assert (start >= bounds[text]).all() and (stop <= bounds[text + 1]).all()
        leads, _, targets = stream.gathered(start, text, stride)
        for k in range(len(start)):
            for j in range(A.WINDOW):
                at = start[k] + stride - A.WINDOW + j
                assert leads[k, j] == (A.CLASSES if at - 1 < bounds[text[k]] else min(at - 1, 110) % 50)
            assert targets[k, : stop[k] - start[k]].tolist() == [v % 50 for v in range(start[k], stop[k])]


def test_rounds_together_take_every_training_window_once():
    taken = defaultdict(int)
    order = np.random.default_rng([5]).permutation(np.arange(101))
    for turn in range(A.ROUNDS):
        for k in order[turn :: A.ROUNDS]:
            taken[int(k)] += 1
    assert taken == {k: 1 for k in range(101)}

"""Toxicity scores from a convolutional text classifier trained in numpy.

Words (runs of letters, digits and non-ASCII characters, ASCII lower-cased) are hashed to embedding
rows. Filters of several widths slide over the whole text, each filter keeps its maximum, and a logistic
layer on the maxima gives the score. Embeddings, filters and layer are trained together. The first ``GIVEN``
embedding sizes start from how often a word stands in toxic and other training texts (shrunk; equal texts
count once) and are trained on from there; while training, a text sees the start values as computed without
its own fold, so that words of one text are not learnt by heart. Words of fewer than ``LEAST_TEXTS`` texts keep
their start. Thresholds per language are calibrated on training rows scored with the start values of the other
folds; the language is no input of the score.

The classifier is fitted on at most ``MAX_TRAIN`` labelled rows, those of smallest hash of ``doc_id``, without
texts of more than ``MAX_TRAIN_BYTES`` bytes; both bound what reaches the driver. Scoring covers every row and
whole texts, in one pass without a shuffle. Nothing depends on the process: two runs give equal scores.

Edge cases. Null and empty texts get the score of a text without words. Labels that are null or whose
document is missing are not used; without any labelled row the score is the prior 0.5 of an untrained
model. Repeated rows are scored each; null ids and extra columns are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.textscan import WORD_GAP, lower_ascii, mix, span_hashes, text_slices, word_spans

BUCKETS = 1 << 18
SIZE = 12
WIDTHS = (1, 2, 3)
FILTERS = 12  # of each width
MAX_TRAIN = 6_000
MAX_TRAIN_BYTES = 1 << 16
EPOCHS = 12
EMBED_RATE = 0.5
GIVEN = 2
LEAST_TEXTS = 5
FOLDS = 5
BATCH = 32
RATE = 0.01
PREDICT_AT = 0.7


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (from 1) of all words, and each text's bounds; ``max(WIDTHS)`` empty rows 0 follow each text."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets, WORD_GAP)
    hashed = (span_hashes(data, starts, ends) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    pad = max(WIDTHS)
    bounds = first + pad * np.arange(len(first))
    rows = np.zeros(int(bounds[-1]), np.int64)
    rows[np.arange(len(hashed)) + pad * np.repeat(np.arange(len(first) - 1), np.diff(first))] = hashed
    return rows, bounds


def word_evidence(texts: list[np.ndarray], same: np.ndarray, target: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per embedding row two shrunk measures of how toxic its texts are, and the number of texts."""
    _, first = np.unique(np.where(used, same, -1), return_index=True)
    chosen = [d for d in first if used[d]]
    toxic, every = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for d in chosen:
        every[texts[d]] += 1
        toxic[texts[d]] += target[d]
    share = float(np.mean(target[chosen])) if chosen else 0.5
    share = min(max(share, 0.01), 0.99)
    score = (toxic - every * share) / np.sqrt(every * share * (1 - share) + 1)
    odds = np.log((toxic + 2 * share) / ((every + 2) * share))
    given = np.stack([np.clip(score / 4, -1, 4), np.clip(odds, -1, 3) * (every >= 3)], axis=1).astype(np.float32)
    given[0] = 0
    return given, every


class TextCnn:
    """Hashed embeddings, convolutions of several widths, max pooling, logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.02, (BUCKETS, SIZE)).astype(np.float32)
        self.embed[:, :GIVEN] = 0
        self.embed[0] = 0
        self.conv = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1.0)

    def pooled(self, vectors: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maxima per text and filter, before the rectifier, and the values they were taken from."""
        tops, values = [], []
        for w, kernel, shift in zip(WIDTHS, self.conv, self.shift, strict=True):
            n = len(vectors) - w + 1
            value = vectors[:n] @ kernel[0]
            for k in range(1, w):
                value += vectors[k : k + n] @ kernel[k]
            value += shift
            for k in range(1, w):  # windows that would reach into the next text
                value[bounds[1:][bounds[1:] - k < n] - k] = -np.inf
            tops.append(np.maximum.reduceat(value, bounds[:-1], axis=0))
            values.append(value)
        return np.concatenate(tops, axis=1), values

    def scores(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.from_vectors(self.embed[rows], bounds)

    def from_vectors(self, vectors: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        top, _ = self.pooled(vectors, bounds)
        return 1 / (1 + np.exp(-(np.maximum(top, 0) @ self.out + self.bias).astype(np.float64)))

    def fit(self, rows: np.ndarray, bounds: np.ndarray, target: np.ndarray, seed: int = 11) -> np.ndarray:
        """Train on all texts; their scores with the start values of the other folds."""
        rng = np.random.default_rng(seed)
        texts = [np.unique(rows[bounds[d] : bounds[d + 1]]) for d in range(len(target))]
        prints = np.array([int.from_bytes(hashlib.blake2b(rows[bounds[d] : bounds[d + 1]].tobytes(), digest_size=8).digest(), "little") for d in range(len(target))], np.uint64)
        same = np.unique(prints, return_inverse=True)[1]
        fold = mix(prints + np.uint64(seed)) % np.uint64(FOLDS)
        whole, spread = word_evidence(texts, same, target, np.ones(len(target), bool))
        outside = [word_evidence(texts, same, target, fold != f)[0] for f in range(FOLDS)]
        weights = [*self.conv, *self.shift, self.out]
        moment = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        slope = [np.float32(0), np.float32(0)]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(target))
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                step += 1
                part = [rows[bounds[d] : bounds[d + 1]] for d in pick]
                own = np.concatenate(part)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in part])])
                vectors = self.embed[own]
                vectors[:, :GIVEN] += np.concatenate([outside[int(fold[d])][p] for d, p in zip(pick, part, strict=True)])
                top, values = self.pooled(vectors, ends)
                hidden = np.maximum(top, 0)
                score = 1 / (1 + np.exp(-(hidden @ self.out + self.bias)))
                err = ((score - target[pick]) / len(pick)).astype(np.float32)
                grads = [np.zeros_like(w) for w in weights]
                grads[-1] = hidden.T @ err
                back = err[:, None] * self.out[None, :] * (top > 0)
                touched, pull = [], []
                for j, w in enumerate(WIDTHS):
                    cols = slice(j * FILTERS, (j + 1) * FILTERS)
                    spots = np.stack([ends[d] + np.argmax(values[j][ends[d] : min(ends[d + 1], len(values[j]))], axis=0) for d in range(len(pick))])
                    g = back[:, cols]
                    grads[len(WIDTHS) + j] = g.sum(0)
                    for k in range(w):
                        at = np.minimum(spots + k, len(own) - 1)
                        grads[j][k] = np.einsum("dfe,df->ef", vectors[at], g)
                        touched.append(own[at].reshape(-1))
                        pull.append((g[:, :, None] * self.conv[j][k].T[None]).reshape(-1, SIZE))
                rate = RATE * min(1.0, step / 20)
                for w, g, (m, v) in zip(weights, grads, moment, strict=True):
                    g = g + 1e-4 * w
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                g = err.sum()
                slope = [slope[0] + 0.1 * (g - slope[0]), slope[1] + 0.01 * (g * g - slope[1])]
                self.bias = np.float32(self.bias - rate * (slope[0] / (1 - 0.9**step)) / (np.sqrt(slope[1] / (1 - 0.99**step)) + 1e-6))
                at, where = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(at), SIZE), np.float32)
                np.add.at(total, where, np.concatenate(pull))
                total[spread[at] < LEAST_TEXTS] = 0
                self.embed[at] -= EMBED_RATE * total
                self.embed[0] = 0
        scores = np.zeros(len(target))
        for d in range(len(target)):
            own = rows[bounds[d] : bounds[d + 1]]
            vectors = self.embed[own]
            vectors[:, :GIVEN] += outside[int(fold[d])][own]
            scores[d] = self.from_vectors(vectors, np.array([0, len(own)]))[0]
        self.embed[:, :GIVEN] += whole
        return scores


def language_thresholds(scores: np.ndarray, target: np.ndarray, langs: list[str | None], least: int = 10) -> dict[str | None, float]:
    """Per language the cut with the best F1 on training rows; languages with few toxic rows take the pooled cut."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
        k = int(np.argmax(f1))
        return float((s[order[k]] + (s[order[k + 1]] if k + 1 < len(s) else 0.0)) / 2)

    pooled = best(scores, target) if len(target) and target.sum() else PREDICT_AT
    cuts: dict[str | None, float] = {None: pooled}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        cuts[lang] = best(scores[own], target[own]) if target[own].sum() >= least else pooled
    return cuts


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> tuple[TextCnn, dict[str | None, float]]:
    """The classifier and the thresholds, from labelled rows that are not held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~_held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)  # documented bound of the training sample
    short = docs.select("doc_id", "text", "lang").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAIN_BYTES)
    sample = short.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).orderBy("doc_id", F.xxhash64("text")).limit(2 * MAX_TRAIN).toArrow()
    model = TextCnn()
    target = sample.column("toxic").to_numpy().astype(np.float32)
    if not len(target):
        model.out[:] = 0
        model.bias = np.float32(0)
        return model, {None: PREDICT_AT}
    parts, bounds = [], [np.zeros(1, np.int64)]
    for _, _, data, offsets in text_slices(sample.column("text")):
        rows, ends = word_rows(data, offsets)
        parts.append(rows)
        bounds.append(ends[1:] + bounds[-1][-1])
    rows, ends = np.concatenate(parts), np.concatenate(bounds)
    return model, language_thresholds(model.fit(rows, ends, target), target, sample.column("lang").to_pylist())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and, by language, ``threshold`` and ``flagged`` for each row of ``docs``."""
    model, cuts = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(3), 1 << 20):
                rows, bounds = word_rows(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(cnn.scores(rows, bounds))],
                    ["doc_id", "lang", "held_out", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "lang", _held_out().alias("held_out"), "text").mapInArrow(scan, f"doc_id {kind}, lang string, held_out boolean, score double")
    named = [x for lang, cut in cuts.items() if lang is not None for x in (F.lit(lang), F.lit(cut))]
    cut = F.coalesce(F.try_element_at(F.create_map(*named), F.col("lang")), F.lit(cuts[None])) if named else F.lit(cuts[None])
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), cut.alias("threshold"), (F.col("score") >= cut).alias("flagged"))

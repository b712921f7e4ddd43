"""Periodic runs in word sequences: stretches in which the words repeat with one period at least three times.

A run is a stretch of consecutive words whose smallest period ``q`` is such that it has ``max(24, 3 * q)`` words or
more, and that no neighbouring word extends. Runs are found online by a sparse diagonal program: each word looks
up its earlier occurrence, the match length of that lag grows by one if the lag was active at the word before, and
a lag that is not met again has ended and gives its run at once if it matched long enough.

Two facts keep the program sparse without losing a run. First, a run of period ``q`` matches at lag ``q`` over
``max(24 - q, 2 * q)`` words, so an occurrence counts only together with the ``SEED`` words that end there, and
for lags from ``g / 2`` to ``g`` with the ``g`` words that end there (``g`` a power of two). Secondly, only the nearest such
occurrence counts: if a nearer one at lag ``p < q <= g`` matches as well, stretches of periods ``p`` and ``q`` share ``p + q`` words,
so the smallest period divides both and is not ``q``. So a word has at most one lag for each ``g``, and a text of one
word repeated a million times takes a million steps. Contexts are told apart by exact ranks (doubling), not by hashes;
a hash of 16 words only decides which texts need no ranks at all.

Edge cases. A null or empty text has no words and no runs; its collapsed text is empty. Texts of any length are
processed whole, one text in one task at a time. Repeated rows and null ids give a row each; ``rewrite`` is
called with the id as it is. Columns other than ``doc_id`` and ``text`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.textscan import mix, span_hashes, text_slices, word_spans

LEAST_WORDS = 24
LEAST_PERIODS = 3
SEED = 16  # max(24 - q, 2 * q) is 16 at least

Rewrite = Callable[[object, list[bytes]], list[bytes]]

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _repeats_context(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text whether ``SEED`` consecutive words may stand in it twice; never false where they do."""
    starts, ends, first = word_spans(data, offsets)
    busy = np.zeros(len(offsets) - 1, bool)
    if len(starts) < SEED:
        return busy
    hashes, width = span_hashes(data, starts, ends), 1
    while width < SEED:
        hashes = mix(hashes[:-width] * np.uint64(0xD6E8FEB86659FD93) + hashes[width:])
        width *= 2
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = text[: len(hashes)] == text[SEED - 1 :]
    text = text[: len(hashes)][whole]
    keys = mix(hashes[whole] + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    busy[text[order[1:][same]]] = True
    return busy


def earlier_occurrences(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and lags, ascending: where a word in its context has occurred before, at a lag that can be a period."""
    rank, width, at, lag = ids.astype(np.int64), 1, [], []
    while len(rank) > width and LEAST_PERIODS * width <= max(len(ids), LEAST_WORDS):
        keys = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        width *= 2
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        if not same.any():
            break
        rank = np.empty(len(keys), np.int64)
        rank[order[0]] = 0
        rank[order[1:]] = np.cumsum(~same)
        if width >= SEED:
            back = (order[1:] - order[:-1])[same]
            fits = (back < width) & (back >= (width // 2 if width > SEED else 1))
            at.append(order[1:][same][fits] + width - 1)
            lag.append(back[fits])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, lag = np.concatenate(at), np.concatenate(lag)
    order = np.lexsort((lag, at))
    return at[order], lag[order]


def context_words(lag: int) -> int:
    """How many words an occurrence at this lag has to match: the greatest power of two that every run of this period matches."""
    return max(SEED, 1 << int(lag).bit_length())


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of the sequence, by start and period."""
    runs: list[tuple[int, int, int]] = []

    def emit(end: int, matched: dict[int, int]) -> None:
        for lag, n in matched.items():
            if n >= max(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag):
                runs.append((end - n - lag, n + lag, lag))

    active: dict[int, int] = {}  # words matched so far at each lag that the word before matched
    last = -1
    at, lags = earlier_occurrences(ids)
    for word, met in groupby(zip(at.tolist(), lags.tolist(), strict=True), key=lambda x: x[0]):
        if word != last + 1:
            emit(last + 1, active)
            active = {}
        going = {lag: active.pop(lag, context_words(lag) - 1) + 1 for _, lag in met}
        emit(word, active)
        active, last = going, word
    emit(last + 1, active)
    return sorted((s, n, q) for s, n, q in runs)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)])


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For one id in ten, the words from some word on are replaced by a repetition of the first of them. A null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row: all runs by start and period, and the text without repetitions.

    Words are runs of characters other than ASCII white space, numbered from 0. ``rewrite(doc_id, words)`` may
    replace the words of a text before they are scanned. One pass over the texts, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                busy = _repeats_context(data, offsets)
                counts, found, texts = [], [], []
                for d, doc_id in enumerate(ids.to_pylist()):
                    before = data[offsets[d] : offsets[d + 1]].tobytes().split()
                    words = rewrite(doc_id, before) if rewrite else before
                    runs = []
                    if (busy[d] or words is not before) and len(words) >= LEAST_WORDS:
                        number: dict[bytes, int] = {}
                        runs = runs_of(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(collapsed(words, runs))
                run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest exact ``length / period``; ties go to the smaller start, then period. Null without runs."""

    def better(best: Column, run: Column) -> Column:
        wins = best.isNull() | (run.length * best.period > best.length * run.period)
        return F.when(wins, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and hashes of all runs and of the collapsed text, from ``periodic_runs``."""
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

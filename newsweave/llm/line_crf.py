"""Document quality from a linear-chain conditional random field over lines.

Every line of a text (split at ``\\n``) is labelled good or bad. A line is described by shares of kinds of characters and
words, by repetition inside the line and inside the text, and by the same measures of the line before and the line
after it. The chain ties the labels of neighbouring lines together. The forward and backward passes give each line's
probability of being good; their mean, weighted by the lines' lengths, is the text's score. Weights are trained
in numpy by the gradient of the chain's log-likelihood (observed minus expected features), with the label
of a training text standing for each of its lines and every text counting alike.

Training takes at most ``MAX_TRAIN`` labelled rows (those of smallest hash of the id, then of the text), without texts of more than
``MAX_TRAIN_BYTES`` bytes or ``MAX_TRAIN_LINES`` lines. Their line measures are computed in Spark, so at most
``MAX_TRAIN * MAX_TRAIN_LINES`` short rows of numbers reach the driver. Scoring covers all rows and whole texts, in one
pass without a shuffle; the lines of one text are scored in one task.

Edge cases. A null or empty text is one empty line and is scored as such. Labels that are null or whose document is missing are not
used; without labelled rows every score is 0.5. Repeated rows and null ids are scored each (a null id is not
held out). Columns other than ``doc_id`` and ``text`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.textscan import lower_ascii, mix, span_hashes, text_slices, word_spans

MAX_TRAIN = 4_000
MAX_TRAIN_BYTES = 1 << 16
MAX_TRAIN_LINES = 300
STEPS = 200
RATE = 0.1
PENALTY = 1e-3  # of squared weights, against the mean log-likelihood of a text
PREDICT_AT = 0.5

SYMBOLS = b"#*$%&<>@^~=_+\\"
_KINDS = np.zeros((7, 256), bool)  # upper case, letters of ASCII, digits, symbols, exclamation marks, bars, bytes beyond ASCII
_KINDS[0, ord("A") : ord("Z") + 1] = True
_KINDS[1] = _KINDS[0]
_KINDS[1, ord("a") : ord("z") + 1] = True
_KINDS[2, ord("0") : ord("9") + 1] = True
_KINDS[3, list(SYMBOLS)] = True
_KINDS[4, ord("!")] = True
_KINDS[5, ord("|")] = True
_KINDS[6, 0x80:] = True
_MARK = _KINDS[3] | _KINDS[4] | _KINDS[5]

SHARES = 9  # measures that also enter as a hinge at a tenth
MEASURES = 2 * SHARES + 7
FEATURES = 3 * MEASURES + 2


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all lines, and for each text the number of its first line (one more at the end)."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(counts)])


def _added(values: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(line, weights=values, minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``MEASURES`` numbers for each line, the lines' lengths in code points, and each text's first line."""
    starts, ends, first = line_spans(data, offsets)
    n = len(starts)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float64)

    length = within((data & 0xC0) != 0x80)
    kinds = [within(kind[data]) for kind in _KINDS]
    low = lower_ascii(data)
    begin, end, _ = word_spans(low, offsets)
    line = np.searchsorted(starts, begin, "right") - 1
    hashes = span_hashes(low, begin, end)
    words = np.bincount(line, minlength=n).astype(np.float64)
    chars, some = np.maximum(length, 1), np.maximum(words, 1)

    follows = np.zeros(len(line), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    keys = mix(hashes + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    distinct = np.bincount(line[order[new]], minlength=n)

    windows = np.zeros(len(line), bool)
    if len(line) > 2:
        own = text[line]
        three = mix(mix(hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(5) + hashes[2:] + own[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(three)
        twice = np.zeros(len(three), bool)
        same = three[order[1:]] == three[order[:-1]]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= own[2:] == own[:-2]
        for k in range(3):
            windows[k : k + len(three)] |= twice

    spans = span_hashes(data, starts, ends) if n else np.zeros(0, np.uint64)
    again = np.zeros(n, bool)
    of_text = mix(spans + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(of_text, kind="stable")
    again[order[1:][of_text[order[1:]] == of_text[order[:-1]]]] = True
    again &= words > 0

    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    head = data[begin] if len(begin) else np.zeros(0, np.uint8)
    capital = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_KINDS[0][data], out=capital[1:])
    small = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_KINDS[1][data] & ~_KINDS[0][data], out=small[1:])
    shout = (capital[end] - capital[begin] > 1) & (small[end] == small[begin])
    shares = [
        kinds[0] / np.maximum(kinds[1], 1),
        kinds[3] / chars,
        np.minimum(kinds[4] / some, 2),
        kinds[5] / some,
        _added(follows, line, n) / some,
        1 - distinct / some * (words > 0) - (words == 0),
        _added(windows, line, n) / some,
        _added(_MARK[last] & ~_MARK[head], line, n) / some,
        _added(shout, line, n) / some,
    ]
    rest = [np.log1p(length) / 8, np.log1p(words) / 6, kinds[2] / chars, kinds[6] / chars, np.minimum(chars / some / 10, 3), again, words == 0]
    table = np.empty((n, MEASURES))
    for k, share in enumerate(shares):
        table[:, k] = share
        table[:, SHARES + k] = 10 * np.minimum(share, 0.1)
    for k, value in enumerate(rest):
        table[:, 2 * SHARES + k] = value
    return table, length, first


def features(table: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's own measures and those of the lines before and after it, a constant, and whether the line is the first."""
    n, m = table.shape
    out = np.zeros((n, FEATURES))
    out[:, :m] = table
    out[1:, m : 2 * m] = table[:-1]
    out[:-1, 2 * m : 3 * m] = table[1:]
    out[first[:-1], m : 2 * m] = 0
    out[first[1:] - 1, 2 * m : 3 * m] = 0
    out[:, 3 * m] = 1
    out[first[:-1], 3 * m + 1] = 1
    return out


class Chain:
    """Two labels (0 bad, 1 good): weights of a line's features for label 1, and scores of label pairs."""

    def __init__(self) -> None:
        self.weight = np.zeros(FEATURES)
        self.pair = np.zeros((2, 2))

    def passes(self, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logarithms of the forward and backward sums of each line and of each text's total, all texts side by side."""
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        begin, counts = first[:-1][order], counts[order]
        score = np.stack([np.zeros(len(score)), score], axis=1)
        forward, backward = score.copy(), np.zeros_like(score)
        longest = int(counts[0]) if len(counts) else 0
        live = np.searchsorted(-counts, -np.arange(longest), "left")  # texts with more than t lines
        for t in range(1, longest):
            at = begin[: live[t]] + t
            before = forward[at - 1]
            for y in (0, 1):
                forward[at, y] += np.logaddexp(before[:, 0] + self.pair[0, y], before[:, 1] + self.pair[1, y])
        for t in range(longest - 2, -1, -1):
            at = begin[: live[t + 1]] + t
            after = backward[at + 1] + score[at + 1]
            for y in (0, 1):
                backward[at, y] = np.logaddexp(after[:, 0] + self.pair[y, 0], after[:, 1] + self.pair[y, 1])
        ends = forward[first[1:] - 1]
        return forward, backward, np.logaddexp(ends[:, 0], ends[:, 1])

    def marginals(self, table: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability that a line is good, for each line."""
        forward, backward, total = self.passes(features(table, first) @ self.weight, first)
        return np.exp(np.minimum(forward[:, 1] + backward[:, 1] - np.repeat(total, np.diff(first)), 0))

    def gradient(self, x: np.ndarray, first: np.ndarray, good: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood and its slopes; ``good`` labels lines, ``share`` weighs texts."""
        score = x @ self.weight
        forward, backward, total = self.passes(score, first)
        counts = np.diff(first)
        by_line, totals = np.repeat(share, counts), np.repeat(total, counts)
        slope = x.T @ (by_line * (good - np.exp(forward[:, 1] + backward[:, 1] - totals)))
        later = np.ones(len(x), bool)
        later[first[:-1]] = False
        at = np.flatnonzero(later)
        pairs = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                expected = np.exp(forward[at - 1, a] + self.pair[a, b] + b * score[at] + backward[at, b] - totals[at])
                pairs[a, b] = by_line[at] @ ((good[at - 1] == a) * (good[at] == b) - expected)
        path = np.add.reduceat(good * score, first[:-1]) - total
        links = np.zeros(len(x))
        links[at] = self.pair[good[at - 1].astype(int), good[at].astype(int)]
        return float(share @ (path + np.add.reduceat(links, first[:-1]))), slope, pairs

    def fit(self, table: np.ndarray, first: np.ndarray, target: np.ndarray) -> None:
        """Ascend the penalised log-likelihood; a text's lines share its label and its weight."""
        counts = np.diff(first)
        x, good, share = features(table, first), np.repeat(target.astype(float), counts), 1 / counts / len(counts)
        held = [(np.zeros_like(w), np.zeros_like(w)) for w in (self.weight, self.pair)]
        for step in range(1, STEPS + 1):
            _, slope, pairs = self.gradient(x, first, good, share)
            for w, g, (m, v) in zip((self.weight, self.pair), (slope, pairs), held, strict=True):
                g = g - PENALTY * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            table, _, first = measures(data, offsets)
            flat = pa.array(table.astype(np.float32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array((first * MEASURES).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["good", "lines"])


def trained(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain fitted to labelled rows that are not held out."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~_held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)  # documented bound of the training sample
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAIN_BYTES).where(lines <= MAX_TRAIN_LINES)
    rows = short.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(MAX_TRAIN).select("good", "text")
    sample = rows.mapInArrow(_training_lines, "good int, lines array<float>").toArrow()
    model = Chain()
    if len(sample):
        lists = sample.column("lines").combine_chunks()
        table = lists.flatten().to_numpy().astype(np.float64).reshape(-1, MEASURES)
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy() // MEASURES)])
        model.fit(table, first, sample.column("good").to_numpy())
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_lines, bad_lines`` for each row of ``docs``.

    ``bad_lines`` are the numbers (from 0) of the lines that are more likely bad than good.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2), 1 << 20):
                table, length, first = measures(data, offsets)
                good = model.marginals(table, first)
                weight = length + 1  # an empty line counts too
                score = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
                bad = np.flatnonzero(good < PREDICT_AT)
                number = bad - np.repeat(first[:-1], np.diff(first))[bad]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, first).astype(np.int32)), pa.array(number.astype(np.int32)))
                keys = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(score), pa.array(np.diff(first)), lists], ["doc_id", "held_out", "score", "n_lines", "bad_lines"])

    rows = docs.select("doc_id", _held_out().alias("held_out"), "text")
    found = rows.mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, n_lines bigint, bad_lines array<int>")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "n_lines", "bad_lines")

"""Edit distance and Jaro-Winkler similarity of whole batches of string pairs, over matrices of code points in numpy.

A batch is handled a few thousand pairs at a time, so work arrays are bounded by the longest string of such a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 4096
WORD = 63  # patterns of up to so many characters fit the bits of a number


def code_points(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of code points, 0 behind each text's end, and the lengths."""
    joined = texts.str.cat()
    sizes = texts.str.len().to_numpy(np.int64)
    flat = np.frombuffer(joined.encode("utf-32-le"), np.uint32) + np.uint32(1)  # no character is 0
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def edit_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows of two code point matrices."""
    out = np.where(la == 0, lb, la)
    short = (la <= WORD) & (la > 0)
    rows = np.flatnonzero(short)
    if len(rows):
        out[rows] = _by_bits(a[rows], la[rows], b[rows], lb[rows])
    rows = np.flatnonzero(la > WORD)
    if len(rows):
        out[rows] = _by_rows(a[rows], la[rows], b[rows], lb[rows])
    return out


def _by_bits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """A column of the distance table in two numbers: which cells are one more, and which one less, than the cell above."""
    one = np.uint64(1)
    places = one << np.arange(min(a.shape[1], WORD), dtype=np.uint64)
    a = a[:, : len(places)]
    top = one << (la - 1).astype(np.uint64)
    more, less, score = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64), la.copy()
    for j in range(int(lb.max(initial=0))):
        equal = ((a == b[:, j : j + 1]) * places).sum(axis=1, dtype=np.uint64)
        upright = equal | less
        across = (((equal & more) + more) ^ more) | equal
        up, down = less | ~(across | more), more & across
        live = j < lb
        score += live & ((up & top) != 0)
        score -= live & ((down & top) != 0)
        up, down = (up << one) | one, down << one
        more, less = down | ~(upright | up), up & upright
    return score


def _by_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The distance table row by row; a running minimum stands for the steps along a row."""
    along = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(along, (len(a), len(along))).astype(np.int64)
    out = lb.copy()
    pick = np.arange(len(a))
    for i in range(a.shape[1]):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(step - along, axis=1) + along
        done = la == i + 1
        out[done] = row[pick[done], lb[done]]
    return out


def jaro_winkler_similarities(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaro similarity raised by a common start of up to four characters where it exceeds 0.7; 1 for equal rows, else 0 for an empty one."""
    n, wide = len(a), max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    same = (la == lb) & (a == b).all(axis=1)
    reach = np.maximum(la, lb) // 2 - 1
    free = np.arange(wide) < lb[:, None]
    taken = np.zeros((n, wide), bool)
    rows, at = np.arange(n), np.arange(wide)
    for i in range(int(la.max(initial=0))):
        fits = free & (b == a[:, i : i + 1]) & (np.abs(at - i) <= reach[:, None]) & (i < la)[:, None]
        first = fits.argmax(axis=1)
        hit = fits[rows, first]
        taken[:, i] = hit
        free[rows[hit], first[hit]] = False
    used = ~free & (at < lb[:, None])
    m = taken.sum(axis=1)
    order_a, order_b = (np.argsort(~x, axis=1, kind="stable") for x in (taken, used))  # matched characters first, in order
    left, right = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    swaps = ((left != right) & (at < m[:, None])).sum(axis=1) / 2
    some = np.maximum(m, 1)
    jaro = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / some) / 3
    start = np.minimum(common_start(a, la, b, lb), 4)
    value = jaro + np.where(jaro > 0.7, 0.1 * start * (1 - jaro), 0.0)
    return np.where(same, 1.0, np.where(m == 0, 0.0, value))


def common_start(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """How many characters two rows have in common at their start."""
    wide = min(a.shape[1], b.shape[1])
    equal = (a[:, :wide] == b[:, :wide]) & (np.arange(wide) < np.minimum(la, lb)[:, None])
    return np.minimum.accumulate(equal, axis=1).sum(axis=1) if wide else np.zeros(len(la), np.int64)


def _parts(a: pd.Series, b: pd.Series) -> Iterator[tuple[np.ndarray, tuple]]:
    """Runs of pairs without nulls, by length so that a long string does not widen the rest."""
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    size = np.maximum(a.str.len().to_numpy(np.float64)[known], b.str.len().to_numpy(np.float64)[known])
    known = known[np.argsort(size, kind="stable")]
    for lo in range(0, len(known), PART):
        rows = known[lo : lo + PART]
        yield rows, (*code_points(a.iloc[rows]), *code_points(b.iloc[rows]))


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    for rows, pair in _parts(a, b):
        out[rows] = jaro_winkler_similarities(*pair)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("edits", T.IntegerType()), T.StructField("start", T.IntegerType())]))
def spelling(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Jaro-Winkler similarity, edit distance and length of the common start of two strings that are not null."""
    similarity, edits, start = np.zeros(len(a)), np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
    for rows, pair in _parts(a, b):
        similarity[rows], edits[rows], start[rows] = jaro_winkler_similarities(*pair), edit_distances(*pair), common_start(*pair)
    return pd.DataFrame({"similarity": similarity, "edits": edits, "start": start})

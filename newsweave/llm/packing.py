"""Hierarchical multi-length packing of token ids into sequences of at most ``max_len`` ids.

A document's ids beyond whole windows are routed to the smallest context tier (a power of two) that
holds them. Tiers are packed from the longest to the shortest: each piece opens a window of its tier,
the gap takes the longest pieces of shorter tiers that fit, and the last bit of a gap takes the head of
a longer piece, so a window ends exactly full. What finds no filler is strung together and cut. Windows
of one size form step groups of ``STEP_IDS`` ids each, so every step has the same number of ids.

Scale. Packing needs no shuffle: each input partition is packed on its own from pools of ``POOL_IDS``
ids, and less than one window is carried from pool to pool. A partition's last ids are cut into windows
of powers of two, so no sequence needs padding.

Edge cases. Null and empty texts are the end id alone. A null ``doc_id`` is kept. Repeated rows are
packed each. Extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.textscan import give_back, subword_coder, text_slices

POOL_IDS = 1 << 20
STEP_IDS = 1 << 15
TEXT_BYTES = 1 << 19
TABLE_PIECES = 400_000  # with the slices above this bounds what a worker holds beside a full executor heap
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]

Piece = tuple[int, int, int]  # length, document, start


def tier_windows(pieces: list[Piece], max_len: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows (powers of two up to ``max_len``) and fewer than ``max_len`` ids of pieces left over."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for n, doc, start in pieces:
        while n >= max_len:
            full.append([(max_len, doc, start)])
            n, start = n - max_len, start + max_len
        if n:
            rest.append((n, doc, start))
    rest.sort()
    strays: list[Piece] = []
    tier = max_len
    while tier >= 1 and rest:
        cut = bisect_right(rest, (tier // 2, 1 << 62, 0)) if tier > 1 else 0
        mine, rest = rest[cut:], rest[:cut]
        for n, doc, start in reversed(mine):
            window, gap = [(n, doc, start)], tier - n
            while gap and rest:
                fits = bisect_right(rest, (gap, 1 << 62, 0)) - 1
                if fits >= 0:
                    window.append(rest.pop(fits))
                else:  # every shorter piece is longer than the gap: take the head of the longest
                    m, other, at = rest.pop()
                    window.append((gap, other, at))
                    insort(rest, (m - gap, other, at + gap))
                gap -= window[-1][0]
            if gap:
                strays += window
            else:
                full.append(window)
        tier //= 2
    return full + (strung := strung_windows(strays, max_len))[0], strung[1]


def strung_windows(pieces: list[Piece], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Pieces one after another, cut at every ``size`` ids; what is left is less than ``size``."""
    full, window, room = [], [], size
    for n, doc, start in pieces:
        while n:
            take = min(n, room)
            window.append((take, doc, start))
            n, start, room = n - take, start + take, room - take
            if not room:
                full.append(window)
                window, room = [], size
    return full, window


def last_windows(pieces: list[Piece], max_len: int) -> list[list[Piece]]:
    """All of ``pieces`` in windows of falling powers of two."""
    done: list[list[Piece]] = []
    size = max_len
    while pieces and size:
        full, pieces = strung_windows(pieces, size)
        done += full
        size //= 2
    return done


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_len: int = 2048) -> DataFrame:
    """One row for each piece of each document of ``docs`` (``doc_id``, ``text``), see ``COLUMNS``."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subword_coder(tokenizer_path, TABLE_PIECES)
        task = TaskContext.get().partitionId() << 33
        sequence, group = 0, 0
        open_groups: dict[int, tuple[int, int]] = {}
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        pool: list[Piece] = []
        size, serial = 0, 0

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence, group
            out: list[list] = [[] for _ in COLUMNS]
            for window in windows:
                width = sum(p[0] for p in window)
                own, filled = open_groups.get(width, (-1, STEP_IDS))
                if filled + width > STEP_IDS:
                    own, filled = task + group, 0
                    group += 1
                open_groups[width] = (own, filled + width)
                at = 0
                for n, doc, start in window:
                    name, ids = held[doc]
                    values = (name, start, n, zlib.crc32(ids[start : start + n].astype("<u4")), len(ids), task + sequence, at, width, own)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    at += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], COLUMNS)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column(1), TEXT_BYTES):
                ids, ends = coder.encode_slice(data, offsets)
                for k in range(hi - lo):
                    own = np.append(ids[ends[k] : ends[k + 1]], ids.dtype.type(end_id))
                    held[serial] = (names[lo + k], own)
                    pool.append((len(own), serial, 0))
                    serial, size = serial + 1, size + len(own)
                    if size >= POOL_IDS:
                        windows, pool = tier_windows(pool, max_len)
                        yield rows(windows)
                        held = {doc: held[doc] for _, doc, _ in pool}
                        size = sum(p[0] for p in pool)
                        give_back()
        windows, pool = tier_windows(pool, max_len)
        yield rows(windows + last_windows(pool, max_len))
        held.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, ", ".join(f"{c} long" for c in COLUMNS))

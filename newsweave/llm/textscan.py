"""Vectorised scans over Arrow string buffers: words, word hashes, shingle sets and subword ids.

Every function works on whole texts. Arrow batches are cut into slices of whole documents so that the
numpy working set stays bounded; one document longer than a slice forms a slice of its own.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_GAP = np.zeros(256, bool)  # everything in ASCII that is neither a letter nor a digit
WORD_GAP[:128] = [not chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 5
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = (n >> 16) + 1 << 16
        for at, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, end_row, bytes, offsets)`` for runs of whole texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(texts):
        hi = min(max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1), len(texts))
        part = texts.slice(lo, hi - lo).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        body = part.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        yield lo, hi, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        lo = hi


def joined_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of batches as one batch each, closed at ``limit`` bytes of ``column``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def give_back() -> None:
    """Hand memory that is free again to the system: Python workers are kept for other tasks, beside a full executor heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each document the index of its first word (one more at the end)."""
    inside = ~gap[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    after = inside.copy()
    after[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    after[edges - 1] = inside[edges - 1]
    return starts, np.flatnonzero(after) + 1, np.searchsorted(starts, offsets)


HASH_BYTES = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span that depends on its bytes and length only; spans ascend.

    Runs of spans of about ``HASH_BYTES`` bytes are hashed one after another, which bounds the work arrays.
    """
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASH_BYTES, "right")))
        base = starts[lo]
        part, first, after = data[base : ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        out[lo:hi] = mix((total[after] - total[first]) * down[first] + (after - first).astype(np.uint64))
        lo = hi
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``width``-word shingles over lower-cased words.

    A document of fewer words gives its whole sequence as one shingle; without words the set is empty.
    """
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    factor = np.uint64(0xD6E8FEB86659FD93)
    n = max(0, len(words) - width + 1)
    rolled = words[:n].copy()
    for k in range(1, width):
        rolled = rolled * factor + words[k : k + n]
    rolled = mix(rolled)
    sets = []
    for d in range(len(offsets) - 1):
        lo, hi = int(first[d]), int(first[d + 1])
        if hi - lo >= width:
            sets.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for w in words[lo:hi]:
                whole = np.uint64((int(whole) * int(factor) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


JOINED_BYTES = 1 << 15  # the library takes about a hundred bytes of memory for each byte of a string


class SubwordCoder:
    """Token ids of whole texts from a public tokenizer file, each distinct piece encoded once.

    A byte-level tokenizer never lets a token cross from a non-space character to a following white
    space character, so a text falls into independent pieces there (white space, then a word). The
    library encodes pieces not met before, strung together; the lengths of the ids' bytes tell the pieces
    apart again. Results are kept in a bounded hash table of flat arrays (about 50 bytes a piece); every hit is
    compared with the piece's own bytes, so equal hashes cannot give wrong ids. A full table keeps the pieces
    that were met again since it was last thinned.
    """

    MAX_PIECES = 1_000_000

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        self.max_pieces = max_pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder()
        self.id_bytes = np.zeros(size, np.int64)  # in a byte-level vocabulary a character stands for a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.id_bytes[i] = len(added[i].content.encode()) if i in added else len(token)
        self.id_type = np.uint16 if size <= 1 << 16 else np.uint32
        self._clear()
        give_back()

    def _clear(self) -> None:
        self.pieces = 0
        self.slots = np.full(1 << 15, -1, np.int32)
        self.key = np.zeros(1 << 14, np.uint64)
        self.again = np.zeros(1 << 14, bool)
        self.at, self.raw = np.zeros((1 << 14) + 1, np.int64), np.zeros(1 << 17, np.uint8)
        self.begin, self.flat = np.zeros((1 << 14) + 1, np.int64), np.zeros(1 << 16, self.id_type)

    @staticmethod
    def ends_clear(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the last character before each of ``ends`` is surely no space, so that a piece may begin there."""
        last = data[ends - 1]
        before = data[np.maximum(ends - 2, 0)]
        plain = (last < 0x80) & ((last < 0x1C) | (last > 0x1F)) & ~_SPACE[last]
        return plain | ((last >= 0x80) & ~((before == 0xC2) | (before == 0x9A) | (before == 0x80) | (before == 0x81)))

    @staticmethod
    def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces: each document's start, and white space after a non-space character.

        After a character that may be a Unicode space no cut is made; that only makes a piece longer.
        """
        space = _SPACE[data]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        if len(cut):
            cut[0] = False
        at = np.flatnonzero(cut)
        cut[at] = SubwordCoder.ends_clear(data, at)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the end of each text's ids with a leading 0."""
        starts = self.piece_starts(data, offsets)
        lone = np.zeros(len(starts), bool)  # a text's first and last piece touch no other
        edges = np.searchsorted(starts, offsets)
        lone[edges[:-1][edges[:-1] < len(starts)]] = True
        lone[edges[1:][edges[1:] > 0] - 1] = True
        ids, ends = self.encode_pieces(data, starts, lone)
        return ids, ends[edges]

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that begin at ``starts`` (from 0 on) and fill ``data``; the end of each piece's ids with a leading 0."""
        bounds = np.append(starts, len(data))
        rows = self._rows(data, bounds, np.zeros(len(starts), bool) if lone is None else lone)
        counts = self.begin[rows + 1] - self.begin[rows]
        filled = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(counts, out=filled[1:])
        at = np.repeat(self.begin[rows] - filled[:-1], counts)
        at += np.arange(filled[-1])
        return np.take(self.flat, at), filled

    def _rows(self, data: np.ndarray, bounds: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """The table row of each piece, after encoding those not met before."""
        keys = span_hashes(data, bounds[:-1], bounds[1:])
        rows = self._find(keys)
        known = np.flatnonzero(rows >= 0)
        self.again[rows[known]] = True
        new = np.flatnonzero(rows < 0)
        if self.pieces + len(new) > self.max_pieces and self.pieces:
            self._thin()
            rows = self._find(keys)
            new = np.flatnonzero(rows < 0)
        if len(new):
            hashes, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            added = self._learn(data, bounds, new[first], lone)
            self._enter(hashes, added)
            rows[new] = added[inverse]
        sizes = np.diff(bounds)
        wrong = sizes != self.at[rows + 1] - self.at[rows]
        if not wrong.any():  # pieces fill the data, so all bytes are compared at once
            at = np.repeat(self.at[rows] - bounds[:-1], sizes)
            at += np.arange(len(data))
            differ = np.flatnonzero(np.take(self.raw, at) != data)
            wrong[np.searchsorted(bounds, differ, "right") - 1] = True
        else:
            wrong[:] = True
        if wrong.any():  # equal hashes of different pieces: rows of their own that no key leads to
            for k in np.flatnonzero(wrong):
                rows[k] = self._learn(data, bounds, np.array([k]), lone)[0]
        return rows

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is not in the table."""
        mask = len(self.slots) - 1
        place = (keys >> np.uint64(20)).astype(np.int64) & mask
        rows = np.take(self.slots, place).astype(np.int64)
        open_ = np.flatnonzero((rows >= 0) & (np.take(self.key, rows, mode="clip") != keys))
        while len(open_):
            place[open_] = (place[open_] + 1) & mask
            rows[open_] = self.slots[place[open_]]
            there = rows[open_]
            open_ = open_[(there >= 0) & (np.take(self.key, there, mode="clip") != keys[open_])]
        return rows

    def _enter(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Make distinct ``keys``, none of them in the table, lead to ``rows``."""
        self.key[rows] = keys
        if 2 * self.pieces > len(self.slots):
            self.slots = np.full(1 << int(3 * self.pieces).bit_length(), -1, np.int32)
            rows = np.arange(self.pieces)
            keys = self.key[: self.pieces]
        mask = len(self.slots) - 1
        place = (keys >> np.uint64(20)).astype(np.int64) & mask
        left = np.arange(len(keys))
        while len(left):
            free = self.slots[place[left]] < 0
            self.slots[place[left[free]]] = rows[left[free]]
            left = left[self.slots[place[left]] != rows[left]]
            place[left] = (place[left] + 1) & mask

    def _learn(self, data: np.ndarray, bounds: np.ndarray, which: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """New rows for the pieces ``which``."""
        which = np.asarray(which)
        apart = lone[which]
        order = np.concatenate([which[~apart], which[apart]])
        sizes = bounds[order + 1] - bounds[order]
        ends = np.cumsum(sizes)
        raw = data[np.repeat(bounds[order] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        joined = int(np.count_nonzero(~apart))
        ids, counts = self._encoded(raw, ends - sizes, ends, joined)
        have, n = self.pieces, len(order)
        self.raw = _room(self.raw, self.at[have] + len(raw))
        self.flat = _room(self.flat, self.begin[have] + len(ids))
        self.at, self.begin, self.key, self.again = (_room(x, have + n + 1) for x in (self.at, self.begin, self.key, self.again))
        self.raw[self.at[have] : self.at[have] + len(raw)] = raw
        self.flat[self.begin[have] : self.begin[have] + len(ids)] = ids
        self.at[have + 1 : have + n + 1] = self.at[have] + ends
        self.begin[have + 1 : have + n + 1] = self.begin[have] + np.cumsum(counts)
        self.again[have : have + n] = False
        self.pieces += n
        rows = np.empty(n, np.int64)
        rows[np.argsort(apart, kind="stable")] = have + np.arange(n)
        return rows

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each piece's; the first ``joined`` pieces may be encoded in one string."""
        parts, counts = [], []
        at = 0
        while at < joined:
            end = min(joined, max(at + 1, int(np.searchsorted(ends, starts[at] + JOINED_BYTES, "right"))))
            text = raw[starts[at] : ends[end - 1]].tobytes().decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            after = np.cumsum(self.id_bytes[ids]) + starts[at]
            cut = np.searchsorted(after, ends[at:end]) + 1
            if not len(ids) or cut[-1] != len(ids) or not np.array_equal(after[cut - 1], ends[at:end]):
                break  # bytes that are no UTF-8, or a tokenizer whose ids do not stand for bytes
            parts.append(ids)
            counts.append(np.diff(cut, prepend=0))
            at = end
        body = raw.tobytes()
        pieces = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[at:].tolist(), ends[at:].tolist(), strict=True)]
        for lo in range(0, len(pieces), 256):
            for e in self.tokenizer.encode_batch_fast(pieces[lo : lo + 256], add_special_tokens=False):
                parts.append(np.array(e.ids, np.int64))
                counts.append(np.array([len(e.ids)]))
        return np.concatenate(parts).astype(self.id_type), np.concatenate(counts)

    def _thin(self) -> None:
        """Keep the pieces met again, or none if they fill half of the table."""
        keep = np.flatnonzero(self.again[: self.pieces])
        if 2 * len(keep) > self.max_pieces:
            return self._clear()
        old = self.key, self.at, self.raw, self.begin, self.flat
        self._clear()
        for name, bounds, body in (("at", old[1], old[2]), ("begin", old[3], old[4])):
            sizes = bounds[keep + 1] - bounds[keep]
            ends = np.cumsum(sizes)
            taken = body[np.repeat(bounds[keep] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
            setattr(self, name, np.append(np.int64(0), ends))
            setattr(self, "raw" if name == "at" else "flat", _room(taken, 1 << 16))
        self.pieces = len(keep)
        self.again = np.zeros(len(keep) + 1, bool)
        self.key = _room(np.zeros(1, np.uint64), len(keep) + 1)
        self.slots = np.full(1 << max(15, int(3 * self.pieces).bit_length()), -1, np.int32)
        self._enter(old[0][keep], np.arange(len(keep)))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """``array`` with room for ``size`` entries, grown by half at least."""
    if len(array) >= size:
        return array
    grown = np.zeros(max(int(size), len(array) * 3 // 2), array.dtype)
    grown[: len(array)] = array
    return grown


_coders: dict[str, SubwordCoder] = {}


def subword_coder(path: str, max_pieces: int = SubwordCoder.MAX_PIECES) -> SubwordCoder:
    """One coder for each file and Python worker; ``max_pieces`` bounds its table."""
    if path not in _coders:
        _coders[path] = SubwordCoder(path, max_pieces)
    _coders[path].max_pieces = max_pieces
    return _coders[path]


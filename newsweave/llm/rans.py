"""Static range asymmetric numeral system (rANS) for token ids, vectorised over blocks and lanes.

All blocks share one frequency table. A block deals its ids out to ``LANES`` interleaved 64-bit states
that write 32-bit words to one stream. Every ``EVERY`` steps the states and the stream position are kept
as a checkpoint, so a block decodes in independent parts; a CRC-32 closes the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LANES = 64
EVERY = 256  # steps between checkpoints
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<4sHHIIIII")  # magic, scale bits, lanes, ids, steps, steps between checkpoints, checkpoints, words
MAGIC = b"NWR1"


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2**SCALE_BITS``, at least 1 for each id that occurs."""
    total = int(counts.sum())
    whole = 1 << SCALE_BITS
    if total == 0:
        counts, total = np.ones_like(counts[:1]), 1
    if (counts > 0).sum() > whole:
        raise ValueError("more distinct ids than the scale has slots")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * whole / total).astype(np.int64), 0)
    while (over := int(freq.sum()) - whole) > 0:
        spare = np.maximum(freq - 1, 0)
        cut = np.minimum(spare, spare * over // max(1, int(spare.sum())))
        if not cut.any():
            cut[np.argsort(-spare, kind="stable")[:over]] = 1
            cut = np.minimum(cut, spare)
        freq = freq - cut
    freq[int(np.argmax(freq))] += whole - int(freq.sum())
    return freq


class Tables:
    """Frequencies, their running sums, and the id of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = self.freq << np.uint64(63 - SCALE_BITS)
        self.usual = int(np.argmax(freq))


def _places(flags: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat positions of the set flags, their rows, and consecutive places from ``begin`` on within each row."""
    flat = np.flatnonzero(flags)
    rows = flat // LANES
    shift = begin - (np.cumsum(counts) - counts)
    return flat, rows, np.take(shift, rows) + np.arange(len(flat))


def encode_blocks(blocks: list[np.ndarray], tables: Tables) -> list[bytes]:
    """One self-contained byte string for each array of ids."""
    steps = np.array([-(-len(b) // LANES) for b in blocks], np.int64)
    order = np.argsort(-steps, kind="stable")
    most = int(steps.max(initial=0))
    ids = np.full((len(blocks), most * LANES), tables.usual, np.intp)
    for row, b in enumerate(order):
        ids[row, : len(blocks[b])] = blocks[b]
    ids = ids.reshape(len(blocks), most, LANES)
    sorted_steps = steps[order]
    state = np.full((len(blocks), LANES), LOW, np.uint64)
    words = np.zeros((len(blocks), most * LANES), np.uint32)
    at = np.full(len(blocks), most * LANES, np.int64)
    marks = -(-most // EVERY)
    mark_state = np.zeros((len(blocks), marks, LANES), np.uint64)
    mark_at = np.zeros((len(blocks), marks), np.int64)
    for t in range(most - 1, -1, -1):
        live = int(np.searchsorted(-sorted_steps, -t, "left"))
        now = ids[:live, t]
        f = np.take(tables.freq, now)
        x = state[:live]
        full = x >= np.take(tables.limit, now)
        counts = np.count_nonzero(full, axis=1)
        at[:live] -= counts
        flat, rows, places = _places(full, at[:live], counts)
        words[rows, places] = np.take(x, flat) & np.uint64(0xFFFFFFFF)
        x = x >> (full.astype(np.uint64) << np.uint64(5))
        share = x // f
        state[:live] = (share << np.uint64(SCALE_BITS)) + (x - share * f) + np.take(tables.cum, now)
        if t % EVERY == 0:
            mark_state[:live, t // EVERY] = state[:live]
            mark_at[:live, t // EVERY] = at[:live]
    out: list[bytes] = [b""] * len(blocks)
    for row, b in enumerate(order):
        n = -(-int(steps[b]) // EVERY)
        body = words[row, at[row] :]
        raw = HEADER.pack(MAGIC, SCALE_BITS, LANES, len(blocks[b]), int(steps[b]), EVERY, n, len(body))
        raw += (mark_at[row, :n] - at[row]).astype("<u4").tobytes() + mark_state[row, :n].astype("<u8").tobytes() + body.astype("<u4").tobytes()
        out[b] = raw + struct.pack("<I", zlib.crc32(raw))
    return out


def decode_blocks(raws: list[bytes], tables: Tables, parts: int = 256) -> list[np.ndarray]:
    """The ids of each block; parts between checkpoints decode side by side, ``parts`` at a time."""
    heads, streams, states, begins, lengths, owners = [], [], [], [], [], []
    base = 0
    for b, raw in enumerate(raws):
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {b}: checksum differs")
        magic, scale, lanes, n, steps, every, marks, count = HEADER.unpack_from(raw)
        if (magic, scale, lanes) != (MAGIC, SCALE_BITS, LANES):
            raise ValueError(f"block {b}: unknown layout")
        at = HEADER.size
        begins.append(np.frombuffer(raw, "<u4", marks, at).astype(np.int64) + base)
        at += 4 * marks
        states.append(np.frombuffer(raw, "<u8", marks * LANES, at).reshape(marks, LANES))
        at += 8 * marks * LANES
        streams.append(np.frombuffer(raw, "<u4", count, at))
        base += count
        lengths.append(np.minimum(every, steps - np.arange(marks) * every))
        owners.append(marks)
        heads.append((n, steps))
    if not raws:
        return []
    words = np.append(np.concatenate(streams), np.zeros(1, np.uint32)).astype(np.uint64)
    state, begin, length = np.concatenate(states).astype(np.uint64), np.concatenate(begins), np.concatenate(lengths)
    order = np.argsort(-length, kind="stable")
    flat: list[np.ndarray | None] = [None] * len(order)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for lo in range(0, len(order), parts):
        pick = order[lo : lo + parts]
        x, at, long = state[pick].copy(), begin[pick].copy(), length[pick]
        ids = np.zeros((len(pick), int(long[0]), LANES), np.uint32)
        for t in range(int(long[0])):
            live = int(np.searchsorted(-long, -t, "left"))
            slot = x[:live] & mask
            now = np.take(tables.slots, slot.view(np.int64))
            ids[:live, t] = now
            y = np.take(tables.freq, now) * (x[:live] >> np.uint64(SCALE_BITS)) + slot - np.take(tables.cum, now)
            low = y < LOW
            counts = np.count_nonzero(low, axis=1)
            hits, _, places = _places(low, at[:live], counts)
            y.reshape(-1)[hits] = (np.take(y, hits) << np.uint64(32)) | np.take(words, places)
            at[:live] += counts
            x[:live] = y
        for row, part in enumerate(pick):
            flat[part] = ids[row, : long[row]].reshape(-1)
    done, k = [], 0
    for (n, _), marks in zip(heads, owners, strict=True):
        parts_of = flat[k : k + marks]
        done.append(np.concatenate(parts_of)[:n] if marks else np.zeros(0, np.uint32))
        k += marks
    return done

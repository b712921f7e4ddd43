"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Words (lower-cased) are coded by a public tokenizer, each with a leading space; a text is its words and one
end. The model reads each word by its first and last subword id and predicts the next word's first id: ids
fall into ``CLASSES`` classes by corpus count, the most frequent ones are classes of their own, the others are
dealt into the last classes. One masked attention layer over a window of ``WINDOW`` words and a feed-forward
read-out give the probability of the class as P(group) * P(class in group). Windows overlap by ``WINDOW -
STRIDE``; each word and end is scored once, with at least ``WINDOW - STRIDE`` words before it where the text
has them. The class probability is mixed with the class's corpus share by a weight fitted in training
(online expectation maximisation), so what a word costs depends on the words before it.

Within its class a word has its corpus share; the mass of words seen once (and one more) goes to words by
spelling: their first id, inner ids by corpus share, and a stop. So scores are those of one proper
distribution over sequences of words, unknown ones included.

Training. Every window of every training text is learnt once: each of ``ROUNDS`` rounds takes its part of
the windows, every task runs through its own chunks, and the weights, a few ten thousand numbers, are averaged
after each round. Counts cover all training texts.

Scale. A chunk is a run of documents: its vocabulary with counts and ids, and its words as indexes into that
vocabulary. Vocabularies are cut by hash into as many buckets as keep a bucket near ``BUCKET_WORDS`` entries;
a bucket's counts are added up in one group and go back to their chunks as arrays. A frequent word is one
entry of 14 bytes per chunk, never one per occurrence. A chunk's words are moved once, to meet their counts.

Edge cases. Null and empty texts are the end alone. Repeated rows are scored (and counted) each. A null
``doc_id`` is in the training part. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.textscan import give_back, joined_batches, lower_ascii, span_hashes, subword_coder, text_slices, word_spans
from newsweave.plans.durable import durable

GROUPS = 24
MEMBERS = 24  # classes of a group
CLASSES = GROUPS * MEMBERS
SHARED = 48  # classes that hold more than one id
SIZE = 16
HIDDEN = 32
WINDOW = 32
STRIDE = 24
ROUNDS = 3
BATCH = 256  # training windows of a step
SCORE_BATCH = 256  # windows scored at once; their arrays stay in the processor's cache
RATE = 0.02
CHUNK_BYTES = 1 << 23  # text of one chunk: larger chunks repeat fewer words
BUCKET_WORDS = 1 << 21
SUMS = 16  # partitions that add up weights, a task's after another's
LOG10 = np.float32(1 / np.log(10))


def _chunks(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per run of documents, and one per partition with the counts of first, last and inner ids alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subword_coder(tokenizer_path)
        size = coder.tokenizer.get_vocab_size()
        serial = TaskContext.get().partitionId() << 33
        seen = np.zeros((3, size), np.int64)
        for batch in joined_batches(batches, 2, CHUNK_BYTES):
            for lo, hi, data, offsets in text_slices(batch.column(2), CHUNK_BYTES):
                data = lower_ascii(data)
                starts, ends, first = word_spans(data, offsets)
                train = np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), bool)
                keys, index, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                counts = np.bincount(inverse[np.repeat(train, np.diff(first))], minlength=len(keys))
                ids, bounds = _spaced_ids(coder, data, starts[index], ends[index])
                seen += _id_counts(ids, bounds, counts, size)
                yield _row(
                    chunk=serial, doc_ids=batch.column(0).slice(lo, hi - lo).to_pylist(), lengths=np.diff(first).astype("<i4"), train=train, words=_deflated(inverse.astype("<u4").tobytes()), n_keys=len(keys),
                    keys=keys.astype("<u8"), counts=counts.astype("<u4"), ids=ids.astype("<u4"), id_counts=_deflated(np.diff(bounds).astype("<u4").tobytes()), seen=None,
                )
                serial += 1
        give_back()
        yield _row(chunk=None, doc_ids=None, lengths=None, train=None, words=None, n_keys=None, keys=None, counts=None, ids=None, id_counts=None, seen=seen.astype("<i8"))

    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("train"), "text")
    return rows.mapInArrow(scan, "chunk long, doc_ids array<long>, lengths binary, train binary, words binary, n_keys long, keys binary, counts binary, ids binary, id_counts binary, seen binary")


def _row(**values) -> pa.RecordBatch:
    """A batch of one row; arrays become bytes."""
    kinds = {"chunk": pa.int64(), "n_keys": pa.int64(), "bucket": pa.int64(), "doc_ids": pa.list_(pa.int64())}
    raw = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in values.items()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in raw.items()], list(raw))


def _spaced_ids(coder, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the given words, each with one leading space, and the bounds of each word's ids."""
    sizes = ends - starts + 1
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    source = np.repeat(starts - 1 - bounds[:-1], sizes) + np.arange(bounds[-1])
    spaced = data[np.maximum(source, 0)]
    spaced[bounds[:-1]] = 0x20
    return coder.encode_pieces(spaced, bounds[:-1], ~coder.ends_clear(data, ends))


def _id_counts(ids: np.ndarray, bounds: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """How often each id is a word's first, last and inner (any but the first) id, over all occurrences of the words."""
    if not len(ids):
        return np.zeros((3, size), np.int64)
    every = np.bincount(ids, np.repeat(counts.astype(np.float64), np.diff(bounds)), size)
    first, last = (np.bincount(ids[at], counts, size) for at in (bounds[:-1], bounds[1:] - 1))
    return np.stack([first, last, every - first]).astype(np.int64)


def _deflated(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _inflated(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dictionaries, one at a time: a row holds a chunk of several megabytes."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


@dataclass
class Classes:
    """Fixed tables over ids: classes of first and last ids, shares, and the spelling of words."""

    lead: np.ndarray
    last: np.ndarray
    share: np.ndarray  # log10 of a first id's share within its class
    inner: np.ndarray  # log10 of an inner id, or more of the word
    stop: float  # log10 of a word's end after an id
    mass: np.ndarray  # training words of each class
    even: np.ndarray  # each class's share of all training words and ends

    @classmethod
    def of(cls, seen: np.ndarray, texts: int, end: int) -> Classes:
        """From the counts of first, last and inner ids and the number of training texts, whose end is the id ``end``."""
        first, last, inner = seen.astype(np.float64)
        first, last = first.copy(), last.copy()
        first[end] += texts
        last[end] += texts
        lead = _dealt(first)
        mass = np.bincount(lead, first, CLASSES)
        share = np.log10((first + 1) / (mass + np.bincount(lead, minlength=CLASSES))[lead])
        words, more = first.sum() + 1, inner.sum() + 1
        return cls(lead, _dealt(last), share, np.log10((inner + 1) / (inner.sum() + len(inner)) * more / (words + more)), float(np.log10(words / (words + more))), mass, (mass + 1) / (mass.sum() + CLASSES))

    def spelling(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of each word's spelling within its class."""
        if not len(bounds) - 1:
            return np.zeros(0)
        inner = self.inner[ids]
        inner[bounds[:-1]] = self.share[ids[bounds[:-1]]]
        return np.add.reduceat(inner, bounds[:-1]) + self.stop


def _dealt(counts: np.ndarray) -> np.ndarray:
    """The class of each id: the most frequent ids alone, the others dealt by count into the last ``SHARED`` classes."""
    order = np.argsort(-counts, kind="stable")
    single = CLASSES - SHARED
    of = np.empty(len(counts), np.int64)
    of[order[:single]] = np.arange(min(single, len(order)))
    rest = order[single:]
    if len(rest):
        mass = np.cumsum(counts[rest] + 1e-3)
        of[rest] = single + np.minimum((mass / mass[-1] * SHARED).astype(np.int64), SHARED - 1)
    return of


class AttentionLm:
    """One masked attention layer and a feed-forward read-out over groups and classes; plain numpy, 32-bit."""

    NAMES = ("lead", "last", "place", "query", "key", "value", "hidden", "bend", "group", "group_bias", "member", "member_bias")

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.lead, self.last, self.place = draw(0.3, CLASSES + 1, SIZE), draw(0.3, CLASSES + 1, SIZE), draw(0.1, WINDOW, SIZE)
        self.query, self.key, self.value = (draw(0.25, SIZE, SIZE) for _ in range(3))
        self.hidden, self.bend = draw(0.2, 2 * SIZE, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.group, self.group_bias = draw(0.15, HIDDEN, GROUPS), np.zeros(GROUPS, np.float32)
        self.member, self.member_bias = draw(0.15, GROUPS, HIDDEN, MEMBERS), np.zeros((GROUPS, MEMBERS), np.float32)
        self.mix = 0.5  # weight of the corpus share
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)

    def start_from(self, even: np.ndarray) -> AttentionLm:
        """Biases at the corpus shares of groups and classes."""
        shares = even.reshape(GROUPS, MEMBERS)
        self.group_bias = np.log(shares.sum(1)).astype(np.float32)
        self.member_bias = np.log(shares / shares.sum(1, keepdims=True)).astype(np.float32)
        return self

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([*(w.reshape(-1) for w in self.weights()), np.array([self.mix], np.float32)])

    def load(self, flat: np.ndarray) -> AttentionLm:
        at = 0
        for n in self.NAMES:
            w = getattr(self, n)
            setattr(self, n, np.array(flat[at : at + w.size], np.float32).reshape(w.shape))
            at += w.size
        self.mix = float(flat[at])
        return self

    def forward(self, leads: np.ndarray, lasts: np.ndarray, tail: int) -> tuple:
        """The hidden state at the last ``tail`` places of each window, and what the gradient needs."""
        n, m = len(leads), len(leads) * tail
        x = np.take(self.lead, leads, axis=0)
        x += np.take(self.last, lasts, axis=0)
        x += self.place
        flat = x.reshape(-1, SIZE)  # one product over all windows
        both = np.empty((n, tail, 2 * SIZE), np.float32)
        both[..., :SIZE] = x[:, -tail:]
        q = (np.ascontiguousarray(both[..., :SIZE]).reshape(m, SIZE) @ (self.query * np.float32(SIZE**-0.5))).reshape(n, tail, SIZE)
        k, v = (flat @ self.key).reshape(n, WINDOW, SIZE), (flat @ self.value).reshape(n, WINDOW, SIZE)
        s = q @ k.transpose(0, 2, 1)
        s += self.mask[-tail:]
        if (most := float(s.max(initial=0))) > 60:  # far below what overflows; rows keep their proportions
            s -= most - 60
        np.exp(s, out=s)
        s /= (s.reshape(m, WINDOW) @ np.ones(WINDOW, np.float32) + np.float32(1e-30)).reshape(n, tail, 1)
        np.matmul(s, v, out=both[..., SIZE:])
        h = both.reshape(m, 2 * SIZE) @ self.hidden
        h += self.bend
        np.maximum(h, 0, out=h)
        return h, (x, q, k, v, s, both)

    def class_probability(self, h: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The probability of each target class, and what the gradient needs; rows are sorted by group on the way."""
        group = (targets // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=GROUPS))
        hs, member = np.take(h, order, axis=0), np.take(targets, order) % MEMBERS
        first = h @ self.group
        first += self.group_bias
        second = np.empty((len(h), MEMBERS), np.float32)
        for g, (a, b) in enumerate(zip(ends - np.diff(ends, prepend=0), ends, strict=True)):
            if a < b:
                np.matmul(hs[a:b], self.member[g], out=second[a:b])
                second[a:b] += self.member_bias[g]
        parts = []
        for z, at in ((first, group), (second, member)):
            if (most := float(z.max(initial=0))) > 60:
                z -= most - 60
            np.exp(z, out=z)
            z /= (z @ np.ones(z.shape[1], np.float32) + np.float32(1e-30))[:, None]
            parts.append(z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + at])
        p = parts[0]
        p[order] *= parts[1]
        return p, (group, order, ends, hs, member, first, second)

    def mixed(self, leads: np.ndarray, lasts: np.ndarray, targets: np.ndarray, even: np.ndarray) -> np.ndarray:
        """log10 of the mixed probability of ``targets`` at the last places of each window."""
        h, _ = self.forward(leads, lasts, targets.shape[1])
        flat = targets.reshape(-1)
        p, _ = self.class_probability(h, flat)
        return (np.log((1 - self.mix) * p + self.mix * even[flat] + 1e-300) * LOG10).reshape(targets.shape)

    def train_step(self, leads: np.ndarray, lasts: np.ndarray, targets: np.ndarray, counted: np.ndarray, moments: list, step: int) -> np.ndarray:
        """One Adam step on whole windows; ``counted`` marks the places that count. The probabilities before it."""
        h, (x, q, k, v, s, both) = self.forward(leads, lasts, WINDOW)
        p, (group, order, ends, hs, member, g1, g2) = self.class_probability(h, targets.reshape(-1))
        share = counted.reshape(-1).astype(np.float32) / np.float32(max(1, counted.sum()))
        places = np.arange(len(group))
        g1[places, group] -= 1
        g1 *= share[:, None]
        g2[places, member] -= 1
        g2 *= np.take(share, order)[:, None]
        one = np.ones(len(g1), np.float32)
        grads = {"group": h.T @ g1, "group_bias": one @ g1, "member": np.zeros_like(self.member), "member_bias": np.zeros_like(self.member_bias)}
        gh = g1 @ self.group.T
        back = np.empty_like(hs)
        for g, (a, b) in enumerate(zip(ends - np.diff(ends, prepend=0), ends, strict=True)):
            if a < b:
                np.matmul(hs[a:b].T, g2[a:b], out=grads["member"][g])
                grads["member_bias"][g] = one[a:b] @ g2[a:b]
                np.matmul(g2[a:b], self.member[g].T, out=back[a:b])
        gh[order] += back
        gh *= h > 0
        grads["hidden"], grads["bend"] = both.reshape(-1, 2 * SIZE).T @ gh, one @ gh
        gb = (gh @ self.hidden.T).reshape(both.shape)
        gx, ga = gb[..., :SIZE].copy(), np.ascontiguousarray(gb[..., SIZE:])
        gs = ga @ v.transpose(0, 2, 1)
        gv = s.transpose(0, 2, 1) @ ga
        gs -= ((gs * s).reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(*gs.shape[:2], 1)
        gs *= s
        gq, gk = gs @ k, gs.transpose(0, 2, 1) @ q
        gq *= np.float32(SIZE**-0.5)
        rows, to = x.reshape(-1, SIZE), gx.reshape(-1, SIZE)
        d = np.concatenate([a.reshape(-1, SIZE) for a in (gq, gk, gv)], axis=1)
        grads["query"], grads["key"], grads["value"] = np.split(rows.T @ d, 3, axis=1)
        to += d @ np.concatenate([self.query, self.key, self.value], axis=1).T
        grads["place"] = np.ones(len(gx), np.float32) @ gx.reshape(len(gx), -1)
        grads["place"] = grads["place"].reshape(WINDOW, SIZE)
        columns = np.ascontiguousarray(to.T)
        for name, taken in (("lead", leads.reshape(-1)), ("last", lasts.reshape(-1))):
            grads[name] = np.stack([np.bincount(taken, c, CLASSES + 1) for c in columns], axis=1).astype(np.float32)
        rate = np.float32(RATE / (1 + step / 200))
        for name, (m, w2) in zip(self.NAMES, moments, strict=True):
            d, w = grads[name], getattr(self, name)
            m += np.float32(0.1) * (d - m)
            w2 += np.float32(0.02) * (d * d - w2)
            w -= rate * (m / np.float32(1 - 0.9**step)) / (np.sqrt(w2 / np.float32(1 - 0.98**step)) + np.float32(1e-7))
        return p


@dataclass
class Stream:
    """The words of a chunk, an end after each text."""

    tokens: np.ndarray  # indexes into the vocabulary, whose length stands for the end
    bounds: np.ndarray  # first token of each text, and the end
    lead: np.ndarray  # class of each token's first id
    last: np.ndarray
    ids: np.ndarray  # of the vocabulary
    id_bounds: np.ndarray

    @classmethod
    def of(cls, row: dict, classes: Classes, end: int) -> Stream:
        words = np.frombuffer(_inflated(row["words"]), "<u4").astype(np.int64)
        after = np.cumsum(np.frombuffer(row["lengths"], "<i4").astype(np.int64))
        ids = np.frombuffer(row["ids"], "<u4")
        sizes = np.frombuffer(_inflated(row["id_counts"]), "<u4").astype(np.int64)
        id_bounds = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=id_bounds[1:])
        tokens = np.insert(words, after, len(sizes))
        firsts, lasts = np.append(ids[id_bounds[:-1]], end), np.append(ids[id_bounds[1:] - 1], end)
        bounds = np.concatenate([[0], after + np.arange(1, len(after) + 1)])
        return cls(tokens, bounds, classes.lead[firsts][tokens], classes.last[lasts][tokens], ids, id_bounds)

    def windows(self, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each window's scored part, and its text: each token is in one of them."""
        sizes = np.diff(self.bounds)
        number = -(-sizes // stride)
        text = np.repeat(np.arange(len(sizes)), number)
        rank = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        start = self.bounds[:-1][text] + rank * stride
        return start, np.minimum(start + stride, self.bounds[1:][text]), text

    def gathered(self, start: np.ndarray, text: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (the token before each place, ``CLASSES`` before a text) and targets of windows that end at ``start + stride``."""
        at = start[:, None] + np.arange(stride - WINDOW, stride)
        before = at - 1
        outside = before < self.bounds[text][:, None]
        before = np.clip(before, 0, len(self.tokens) - 1)
        leads, lasts = np.take(self.lead, before), np.take(self.last, before)
        leads[outside] = CLASSES
        lasts[outside] = CLASSES
        return leads, lasts, np.take(self.lead, np.minimum(at[:, -stride:], len(self.tokens) - 1))


def _summed(chunks: DataFrame, size: int) -> np.ndarray:
    """The counts of first, last and inner ids over all partitions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * size, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["at", "n"])

    out = np.zeros(3 * size, np.int64)
    for row in chunks.where("seen IS NOT NULL").select("seen").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]  # three rows for each vocabulary entry at most
    return out.reshape(3, size)


def _totals(chunks: DataFrame) -> DataFrame:
    """``chunk, bucket, totals`` (32-bit counts over all chunks of the bucket's words), and per bucket a row of ``once``.

    ``once`` holds the first id of each word counted once, ``kinds`` and ``n`` the distinct and all counted words.
    """
    n = chunks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    bits = max(4, int(n // BUCKET_WORDS).bit_length())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys, counts, ids = np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["ids"], "<u4")
                sizes = np.frombuffer(_inflated(row["id_counts"]), "<u4").astype(np.int64)
                leads = ids[np.cumsum(sizes) - sizes]
                cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                at = np.concatenate([[0], cut, [len(keys)]])
                used = np.flatnonzero(np.diff(at))
                pieces = lambda x: pa.array([x[at[b] : at[b + 1]].tobytes() for b in used], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), row["chunk"], np.int64)), pa.array(used.astype(np.int64)), pieces(keys), pieces(counts), pieces(leads)], ["chunk", "bucket", "keys", "counts", "leads"]
                )

    def add(table: pa.Table) -> pa.Table:
        keys, counts, leads = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", "<u8"), ("counts", "<u4"), ("leads", "<u4")))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) // 8 for x in table.column("keys").to_pylist()])
        each = np.split(total[inverse].astype("<i8"), ends[:-1])
        bucket = table.column("bucket")[0].as_py()
        rows = [(chunk, bucket, _deflated(x.tobytes()), None, None, None) for chunk, x in zip(table.column("chunk").to_pylist(), each, strict=True)]
        rows.append((None, bucket, None, leads[first[total == 1]].astype("<u4").tobytes(), int((total > 0).sum()), int(total.sum())))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "bucket", "totals", "once", "kinds", "n"])

    parts = chunks.where("chunk IS NOT NULL").select("chunk", "keys", "counts", "ids", "id_counts").mapInArrow(split, "chunk long, bucket long, keys binary, counts binary, leads binary")
    return parts.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, totals binary, once binary, kinds long, n long")


def fit(chunks: DataFrame, classes: Classes, end: int) -> np.ndarray:
    """Weights after ``ROUNDS`` rounds of local passes and averaging; together the rounds take every training window once."""
    shared = chunks.sparkSession.sparkContext
    weights = AttentionLm().start_from(classes.even).flat()
    for turn in range(ROUNDS):
        given = shared.broadcast((weights, classes))  # of fixed size

        def local(batches: Iterator[pa.RecordBatch], given=given, turn=turn) -> Iterator[pa.RecordBatch]:
            start_weights, named = given.value
            model = AttentionLm().load(start_weights)
            moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
            even = named.even.astype(np.float32)
            step, hits, places = 0, 0.0, 0.0
            for batch in batches:
                for row in _rows(batch):
                    stream = Stream.of(row, named, end)
                    start, stop, text = stream.windows(WINDOW)
                    mine = np.flatnonzero(np.frombuffer(row["train"], bool)[text])
                    order = np.random.default_rng([row["chunk"]]).permutation(mine)[turn::ROUNDS]
                    for lo in range(0, len(order), BATCH):
                        pick = order[lo : lo + BATCH]
                        leads, lasts, targets = stream.gathered(start[pick], text[pick], WINDOW)
                        counted = start[pick][:, None] + np.arange(WINDOW) < stop[pick][:, None]
                        step += 1
                        p = model.train_step(leads, lasts, targets, counted, moments, step)[counted.reshape(-1)]
                        u = model.mix * even[targets[counted]]
                        hits, places = 0.98 * hits + float((u / (u + (1 - model.mix) * p + 1e-30)).sum()), 0.98 * places + len(p)
                        model.mix = min(max(hits / places, 1e-4), 0.9999)
            if step:
                yield pa.RecordBatch.from_arrays([pa.array([float(step)]), pa.array([model.flat().astype(np.float64)])], ["steps", "weights"])

        rows = chunks.where("chunk IS NOT NULL").select("chunk", "words", "lengths", "train", "ids", "id_counts")
        found = rows.mapInArrow(local, "steps double, weights array<double>").repartition(SUMS).mapInArrow(_weighted_mean, "steps double, weights array<double>").collect()  # ``SUMS`` rows of weights
        if steps := sum(r["steps"] for r in found):
            weights = sum(r["steps"] / steps * np.array(r["weights"]) for r in found)
        given.unpersist()
    return weights


def _weighted_mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: all steps, and the mean of the weights by steps."""
    steps, total = 0.0, None
    for batch in batches:
        for n, w in zip(batch.column(0), batch.column(1), strict=True):
            part = n.as_py() * w.values.to_numpy()
            steps, total = steps + n.as_py(), part if total is None else total + part
    if steps:
        yield pa.RecordBatch.from_arrays([pa.array([steps]), pa.array([total / steps])], ["steps", "weights"])


def scored(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``."""
    spark = docs.sparkSession
    coder = subword_coder(tokenizer_path)
    size = coder.tokenizer.get_vocab_size()
    end = size - 1  # the end-of-text id
    chunks = durable(_chunks(docs, tokenizer_path), "chunks")
    totals = durable(_totals(chunks), "totals")
    once = np.zeros(size, np.int64)
    stats = totals.where("chunk IS NULL").mapInArrow(_once_by_id, "id long, once long, kinds long, n long").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("once", "kinds", "n")])
    kinds = n_words = 0
    for r in stats.collect():  # one row for each vocabulary entry at most
        if r["id"] is None:
            kinds, n_words = r["kinds"], r["n"]
        else:
            once[r["id"]] = r["once"]
    texts = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 != 2, F.lit(True))).count()
    n_all, n_kinds = n_words + texts, kinds + (texts > 0)
    classes = Classes.of(_summed(chunks, size), texts, end)
    model = AttentionLm().load(fit(chunks, classes, end))
    escape = np.bincount(classes.lead, once, CLASSES) + 1
    given = spark.sparkContext.broadcast((model, classes, escape))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, named, spare = given.value
        even = named.even.astype(np.float32)
        for batch in batches:
            for row in _rows(batch):
                stream = Stream.of(row, named, end)
                parts = {p["bucket"]: p["totals"] for p in row["parts"] or ()}
                count = np.frombuffer(b"".join(_inflated(parts[b]) for b in sorted(parts)), "<i8").astype(np.float64)
                share = np.append(word_shares(count, stream.ids, stream.id_bounds, named, spare), word_shares(np.array([texts]), np.array([end]), np.array([0, 1]), named, spare))
                count = np.append(count, texts)
                logp = share[stream.tokens]
                start, stop, text = stream.windows(STRIDE)
                for lo in range(0, len(start), SCORE_BATCH):
                    part = slice(lo, lo + SCORE_BATCH)
                    leads, lasts, targets = stream.gathered(start[part], text[part], STRIDE)
                    got = lm.mixed(leads, lasts, targets, even)
                    at = start[part][:, None] + np.arange(STRIDE)
                    inside = at < stop[part][:, None]
                    logp[at[inside]] += got[inside]
                c = count[stream.tokens]
                base = np.log10((c + 1) / (n_all + 1 * (n_kinds + 1)))
                first = stream.bounds[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(~np.frombuffer(row["train"], bool)),
                        pa.array(np.diff(stream.bounds)),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                        pa.array(np.full(len(first), n_all, np.int64)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(logp, first)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    per_chunk = totals.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "totals")).alias("parts"))
    rows = chunks.where("chunk IS NOT NULL").select("chunk", "doc_ids", "lengths", "train", "words", "ids", "id_counts")
    joined = rows.join(per_chunk, "chunk", "left")  # a chunk without words has no totals
    return joined.drop("chunk").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _once_by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words counted once begin with each id; the row of a null id has the sums of ``kinds`` and ``n``."""
    total: dict[int, int] = {}
    kinds = n = 0
    for batch in batches:
        for row in _rows(batch):
            for i, m in zip(*np.unique(np.frombuffer(row["once"], "<u4"), return_counts=True), strict=True):
                total[int(i)] = total.get(int(i), 0) + int(m)
            kinds, n = kinds + row["kinds"], n + row["n"]
    columns = ([*total, None], [*total.values(), 0], [0] * len(total) + [kinds], [0] * len(total) + [n])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "once", "kinds", "n"])


def word_shares(count: np.ndarray, ids: np.ndarray, bounds: np.ndarray, classes: Classes, escape: np.ndarray) -> np.ndarray:
    """log10 of each word's probability within its class: its corpus share, or by spelling within the mass set aside."""
    if not len(count):
        return np.zeros(0)
    own = classes.lead[ids[bounds[:-1]]]
    spelt = classes.spelling(ids, bounds)
    whole = classes.mass[own] + escape[own]
    known = np.log10(np.maximum(count / whole + escape[own] / whole * 10.0 ** np.maximum(spelt, -300), 1e-300))
    return np.where(count > 0, known, np.log10(escape[own] / whole) + spelt)

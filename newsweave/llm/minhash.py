"""Near-duplicate detection by HyperMinHash.

A document's set holds its distinct word shingles. Each set is compressed to ``REGISTERS`` registers
(one per bucket of the hash range): the leading-zero count of the bucket's smallest hash and the ten
mantissa bits after its leading one. Empty buckets borrow the register of a pseudo-random full bucket,
in the same order for every document. Bands of registers give candidate keys; two packed bits of each
register give a Jaccard estimate that is corrected for accidental collisions; what the estimate does
not exclude is verified on the full shingle sets of the whole texts.

Scale. Documents with equal sets (equal in size and two 64-bit sums over their elements) collapse into one class
first, on the map side; a class is numbered when its table is written, so no two classes share a number. Only classes
of several documents or with links are looked up again by their rows. Within a key every class is compared with the
class of the key's smallest ``doc_id`` only (the document that would stay; a star, linear in the group); after
the links found so far are closed into components, only pairs of one key that lie in different components are
looked at, and the join itself drops those that cannot be linked. No cap on groups, no pairs within a component.
What drops a pair is its sizes or its odd sketch, both for certain: every bit in which two odd sketches differ
needs an element that the sets do not share, so more such bits than a link allows exclude it. The estimate of the
registers drops what is ``SLACK`` standard deviations below the threshold.

Edge cases. Null, empty and blank texts have an empty set, are linked with nothing and form their own
component. A text of fewer words than a shingle is one shingle. Repeated rows give one result row each
(same class); rows that share an id but not the text are told apart by a text hash. A null ``doc_id`` is kept:
its row reports a null component and is kept. Extra columns of the input are ignored here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.textscan import give_back, mix, shingle_sets, text_slices
from newsweave.llm.words import unused_names
from newsweave.plans.durable import broadcast_if_small, durable, scratch
from newsweave.plans.graph import connected_components

REGISTERS = 256
BUCKET_BITS = 8
MANTISSA_BITS = 10
FILL_ROUNDS = 96
PLANES = 8  # longs of packed register bits: two planes of 256 bits
ODD = 16  # longs of the odd sketch: 1,024 bits
MAX_BROADCAST_IDS = 2_000_000
SAME_SET = ["n_shingles", "set_a", "set_b"]  # rows that agree in these have one set
MISS_PROBABILITY = 1e-7  # of a pair at the threshold, over all bands
SLACK = 5.5  # standard deviations: a pair at the threshold falls below with a probability of 2e-8


def _fill_order() -> np.ndarray:
    at = np.arange(REGISTERS, dtype=np.uint64)
    rounds = np.arange(1, FILL_ROUNDS + 1, dtype=np.uint64)[:, None]
    return (mix(at[None, :] * np.uint64(0x9E3779B97F4A7C15) + mix(rounds)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each sorted distinct hash set; rows of empty sets are all 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    cell = owner * REGISTERS + (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    least = np.ones(len(cell), bool)
    least[1:] = cell[1:] != cell[:-1]  # hashes ascend within a set, so the first of a bucket is its smallest
    rest = every[least] << np.uint64(BUCKET_BITS)
    top = np.frexp((rest >> np.uint64(12)).astype(np.float64))[1]  # exact: 52 bits
    zeros = np.where(top > 0, 52 - top, 52)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[cell[least]] = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    known = out.copy()
    row, col = np.nonzero((out == 0) & (sizes > 0)[:, None])
    for order in _fill_order():
        got = known[row, order[col]]
        full = got > 0
        out[row[full], col[full]] = got[full]
        row, col = row[~full], col[~full]
        if not len(row):
            return out
    for step in range(1, REGISTERS):  # few-element sets: the next full bucket around the circle
        got = known[row, (col + step) % REGISTERS]
        full = got > 0
        out[row[full], col[full]] = got[full]
        row, col = row[~full], col[~full]
        if not len(row):
            break
    return out


def jaccard_estimate(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Jaccard estimates from rows of registers reduced to ``bits`` bits, corrected for chance agreement."""
    chance = 0.5**bits
    return np.maximum(0.0, ((a == b).mean(axis=-1) - chance) / (1 - chance))


def banding(threshold: float, miss: float = MISS_PROBABILITY) -> tuple[int, int]:
    """Registers per band and number of bands such that a pair at ``threshold`` is missed with probability ``miss``.

    The longest bands that still fit into the registers are the most selective.
    """
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
        if rows * bands <= REGISTERS:
            return rows, bands
    return 1, REGISTERS


def text_key() -> F.Column:
    """Tells rows of one id but different texts apart; a null text is as good as an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def sketches(docs: DataFrame, threshold: float, width: int = 5) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_a, set_b, bands, planes, odd`` for each row of ``doc_id, text``.

    ``set_a`` and ``set_b`` fingerprint the whole set, ``bands`` are the candidate keys, ``planes`` the
    two low bits of each (mixed) register and ``odd`` the parity of each of 1,024 cells of the set.
    """
    rows, bands = banding(threshold)
    order = np.argsort(mix(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(77)))[: rows * bands]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                sets = shingle_sets(data, offsets, width)
                regs = registers(sets)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                prints = np.zeros((2, len(sets)), np.uint64)
                for d, s in enumerate(sets):
                    prints[0, d] = np.add.reduce(mix(s + np.uint64(11)))
                    prints[1, d] = np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                keys = np.zeros((len(sets), bands), np.uint64)
                picked = regs[:, order].reshape(len(sets), bands, rows).astype(np.uint64)
                for k in range(rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + picked[:, :, k])
                keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :])
                low = mix(regs.astype(np.uint64))
                planes = np.concatenate([np.packbits((low >> np.uint64(p)) & np.uint64(1), axis=1).view(np.uint64) for p in (20, 21)], axis=1)
                keys, planes = keys.view(np.int64), np.ascontiguousarray(planes).view(np.int64)
                cells = np.concatenate([mix(s + np.uint64(5)) >> np.uint64(54) for s in sets]).astype(np.int64) + np.repeat(np.arange(len(sets)), sizes) * 64 * ODD
                parity = (np.bincount(cells, minlength=len(sets) * 64 * ODD) & 1).astype(np.uint8)
                odd = np.packbits(parity).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(sizes),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1))),
                        pa.ListArray.from_arrays(np.arange(0, len(sets) * PLANES + 1, PLANES, dtype=np.int32), pa.array(planes.reshape(-1))),
                        pa.ListArray.from_arrays(np.arange(0, len(sets) * ODD + 1, ODD, dtype=np.int32), pa.array(odd)),
                    ],
                    ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "planes", "odd"],
                )
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text").mapInArrow(
        scan, "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, planes array<long>, odd array<long>"
    )


def _excluded(threshold: float, p: str, q: str) -> F.Column:
    """True where sizes, odd sketches or the corrected estimate rule out a link between rows ``p`` and ``q``."""
    half = PLANES // 2
    differ = " + ".join(f"bit_count(({p}.planes[{i}] ^ {q}.planes[{i}]) | ({p}.planes[{i + half}] ^ {q}.planes[{i + half}]))" for i in range(half))
    apart = " + ".join(f"bit_count({p}.odd[{i}] ^ {q}.odd[{i}])" for i in range(ODD))
    small, large = f"least({p}.n_shingles, {q}.n_shingles)", f"greatest({p}.n_shingles, {q}.n_shingles)"
    allowed = f"{(1 - threshold) / (1 + threshold)} * ({p}.n_shingles + {q}.n_shingles)"
    agree = threshold + (1 - threshold) / 4  # expected share of equal two-bit registers at the threshold
    slack = f"{SLACK} * sqrt({agree * (1 - agree) / 0.75**2} / least({REGISTERS}, {small}))"
    return F.expr(f"({small} < {threshold} * {large} - 1e-6) OR ({apart} > {allowed} + 1e-6) OR (1 - ({differ}) / {REGISTERS}.0 / 0.75 < {threshold} - {slack})")


def _verified(pairs: DataFrame, texts: DataFrame, numerator: int, width: int) -> DataFrame:
    """Of ``(a, b)`` class pairs those with ``100 * intersection >= numerator * union`` on full shingle sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for ids, column in ((0, 2), (1, 3)):
                keys, first, at = np.unique(batch.column(ids).to_numpy(), return_index=True, return_inverse=True)
                sets: list[np.ndarray] = []
                for _, _, data, offsets in text_slices(batch.column(column).take(pa.array(first))):
                    sets += shingle_sets(data, offsets, width)
                sides.append((sets, at))
            keep = []
            for x, y in zip(sides[0][1], sides[1][1], strict=True):
                a, b = sides[0][0][x], sides[1][0][y]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= numerator * (len(a) + len(b) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])
        give_back()

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key, group`` for each row of ``docs`` (``doc_id``, ``text``).

    Documents are linked when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest ``doc_id`` that links reach and ``kept`` marks that document. ``group`` is one
    number for all rows of a component of several rows, null for rows that are alone.
    """
    with scratch(docs.sparkSession) as keep:
        rows = keep(durable(sketches(docs, percent / 100, width), "sketches"))
        changed = keep(durable(_components(docs, rows, percent, width), "changed"))
        found = rows.join(broadcast_if_small(changed, MAX_BROADCAST_IDS), SAME_SET, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key", "group")


def _components(docs: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """``n_shingles, set_a, set_b, component, group`` of each set of ``rows`` that has links or several rows."""
    threshold = percent / 100
    owner = F.struct("doc_id", "text_key")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*SAME_SET)
    classes = classes.agg(F.min(owner).alias("rep"), F.min_by(F.struct("bands", "planes", "odd"), owner).alias("s"), F.count("*").alias("n_rows"))
    numbered = classes.select(F.monotonically_increasing_id().alias("id"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"), *SAME_SET, "s.*", "n_rows")
    classes = durable(numbered, "classes")

    keys = classes.select(F.explode("bands").alias("key"), "id", "doc_id")
    firsts = keys.groupBy("key").agg(F.min(F.struct("doc_id", "id"))["id"].alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    keys = keys.drop("doc_id")
    shape = classes.select("id", "n_shingles", "planes", "odd")
    stars = keys.join(firsts, "key").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    x, y = shape.alias("x"), shape.alias("y")
    stars = durable(stars.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(~_excluded(threshold, "x", "y")).select("a", "b"), "stars")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text")

    def needed(pairs: DataFrame) -> DataFrame:
        """``id, text`` of the classes in ``pairs``, each once."""
        ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "doc_id", "text_key"), "id"), "ids")
        return texts.join(broadcast_if_small(ids, MAX_BROADCAST_IDS), ["doc_id", "text_key"]).select("id", "text").dropDuplicates(["id"])

    links = durable(_verified(stars, needed(stars), percent, width), "links")
    labels = connected_components(links, "a", "b")

    # Exact rest: pairs of one key across components. Keys whose classes all lie in one component end here.
    named = keys.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_keys = durable(named.join(mixed, "key").join(shape, "id"), "open")
    p, q = open_keys.alias("p"), open_keys.alias("q")
    cross = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.label") != F.col("q.label")) & ~_excluded(threshold, "p", "q"))
    pairs = cross.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    pairs = durable(pairs, "pairs")
    more = _verified(pairs, needed(pairs), percent, width)
    labels = connected_components(links.unionByName(more), "a", "b")

    linked = labels.join(classes.select(F.col("id").alias("node"), "doc_id", *SAME_SET), "node")
    best = linked.groupBy("label").agg(F.min("doc_id").alias("component"))
    linked = linked.join(best, "label").select(F.col("node").alias("id"), *SAME_SET, "component", F.col("label").alias("group"))
    copies = classes.where("n_rows > 1").join(linked, "id", "left_anti").select("id", *SAME_SET, F.col("doc_id").alias("component"), F.col("id").alias("group"))
    return linked.unionByName(copies).drop("id")


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate component; rows without an id stay, and so do rows without words.

    Decided by row: where several rows of a component share the smallest id, the one of smallest text hash stays.
    """
    by_id, by_text = unused_names(docs, "id", "text")
    with scratch(docs.sparkSession) as keep:
        found = durable(near_duplicates(docs, percent, width).where("doc_id IS NOT NULL"), "near")
        first = found.where("kept AND group IS NOT NULL").groupBy("group", "doc_id").agg(F.min("text_key").alias("first"), F.count("*").alias("n")).where("n > 1")
        later = found.where("kept").join(broadcast_if_small(durable(first, "first"), MAX_BROADCAST_IDS), ["group", "doc_id"]).where("text_key <> first")
        dropped = found.where("NOT kept").unionByName(later.select(*found.columns)).select("doc_id", "text_key").distinct()
        again = found.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
        dropped, again = (broadcast_if_small(keep(durable(df.toDF(by_id, by_text), name)), MAX_BROADCAST_IDS) for df, name in ((dropped, "dropped"), (again, "again")))
    keyed = docs.withColumns({by_id: F.col("doc_id").cast("long"), by_text: text_key()})
    left = keyed.join(dropped, [by_id, by_text], "left_anti")
    once = left.join(again, [by_id, by_text], "left_semi").dropDuplicates([by_id, by_text])
    return left.join(again, [by_id, by_text], "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(node, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
l AS (SELECT node, min(label) AS label FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, label AS component_id, d.doc_id = label AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN l ON l.node = d.doc_id
"""

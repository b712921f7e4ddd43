"""Token-id output: whole texts to subword ids, entropy-coded in ascending ``doc_id`` order, and back.

Layout of a written folder: ``tables`` (token, frequency) and ``blocks``, one row for each independent
block: shard, first id within the shard, ids, the documents inside (ids and lengths) and the coded
payload of :mod:`newsweave.llm.rans`. Rows are stored with Spark's Parquet committer, so lost executors
and repeated tasks leave no half-written file and any store that Spark reaches will do. A block holds
whole documents and closes at ``BLOCK_IDS`` ids; a longer document fills a block of its own.

Scale. One range shuffle of two-byte ids gives the order; the frequency table has one row per vocabulary
entry; shard starts are running sums over one row per shard.

Edge cases. Null and empty texts give the end id alone. A null ``doc_id`` sorts first. Repeated ids keep
one run of ids for each row, in order of length and checksum. Extra columns are ignored. An empty table
writes no block and reads back as no row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsweave.llm.rans import SCALE_BITS, Tables, decode_blocks, encode_blocks, normalised
from newsweave.llm.textscan import give_back, subword_coder, text_slices
from newsweave.plans.durable import durable, shared_dir

BLOCK_IDS = 1 << 16
AT_ONCE = 64  # blocks coded side by side


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian 16-bit ids of the whole text, then ``end_id``) for each row.

    Each partition adds one row with ``counts`` alone: how often it has each id, in 64 bits.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subword_coder(tokenizer_path)
        if coder.id_type != np.uint16:
            raise ValueError("vocabularies of more than 65,536 ids are not supported")
        total = np.zeros(1 << 16, np.int64)
        names = ["doc_id", "n_tokens", "ids", "counts"]
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, ends = coder.encode_slice(data, offsets)
                closed = np.insert(ids, ends[1:], end_id)
                total += np.bincount(closed, minlength=1 << 16)
                bounds = ends + np.arange(len(ends))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(bounds)),
                        pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(bounds * 2), pa.py_buffer(closed.astype("<u2"))]).cast(pa.binary()),
                        pa.nulls(hi - lo, pa.binary()),
                    ],
                    names,
                )
        give_back()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_tokens long, ids binary, counts binary")


def _token_counts(tokens: DataFrame) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    return tokens.where("counts IS NOT NULL").select("counts").mapInArrow(add, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _coded_together(rows: Iterable[tuple[int | None, np.ndarray]]) -> Iterator[list[tuple[list, list]]]:
    """Blocks (documents and their ids) to be coded side by side, in order of ``rows``.

    The coder pads all blocks of a call to the longest one, so a document of ``BLOCK_IDS`` ids or more goes
    without company: what waits is handed on before it.
    """
    waiting: list[tuple[list, list]] = []
    names, parts, size = [], [], 0
    for doc, ids in rows:
        if len(ids) >= BLOCK_IDS:
            if names:
                waiting.append((names, parts))
                names, parts, size = [], [], 0
            if waiting:
                yield waiting
            yield [([doc], [ids])]
            waiting = []
            continue
        names.append(doc)
        parts.append(ids)
        size += len(ids)
        if size >= BLOCK_IDS:
            waiting.append((names, parts))
            names, parts, size = [], [], 0
            if len(waiting) >= AT_ONCE:
                yield waiting
                waiting = []
    if names:
        waiting.append((names, parts))
    if waiting:
        yield waiting


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) into the folder ``path``."""
    spark = docs.sparkSession
    tokens = durable(token_rows(docs, tokenizer_path, end_id), "tokens")
    counts = np.zeros(1 << 16, np.int64)
    for row in _token_counts(tokens).collect():  # one row for each vocabulary entry at most
        counts[row["token"]] = row["n"]
    freq = normalised(counts)
    seen = np.flatnonzero(freq)
    table = spark.createDataFrame([(int(t), int(freq[t])) for t in seen], "token long, frequency long")
    table.coalesce(1).write.parquet(f"{path}/tables")
    shared = spark.sparkContext.broadcast(freq)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, shard = Tables(shared.value), TaskContext.get().partitionId()
        first = 0
        for blocks_in in _coded_together((doc, np.frombuffer(raw.as_buffer(), "<u2")) for batch in batches for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            blocks = [np.concatenate(ids) for _, ids in blocks_in]
            sizes = [len(b) for b in blocks]
            starts = [first + sum(sizes[:k]) for k in range(len(sizes))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(blocks), pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([docs_in for docs_in, _ in blocks_in], pa.list_(pa.int64())),
                    pa.array([[len(i) for i in ids] for _, ids in blocks_in], pa.list_(pa.int64())),
                    pa.array(encode_blocks(blocks, tables), pa.binary()),
                ],
                ["shard", "first_id", "n_ids", "doc_ids", "doc_tokens", "payload"],
            )
            first += sum(sizes)

    ordered = tokens.where("ids IS NOT NULL").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", F.crc32("ids"))
    ordered.select("doc_id", "ids").mapInArrow(
        encode, "shard long, first_id long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"
    ).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files in ``path``."""
    table = spark.read.parquet(f"{path}/tables").collect()  # one row for each vocabulary entry at most
    freq = np.zeros(max([1, *(r["token"] + 1 for r in table)]), np.int64)
    for r in table:
        freq[r["token"]] = r["frequency"]
    if freq.sum() != 1 << SCALE_BITS:
        raise ValueError("the frequency table is incomplete")
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                names, starts, lengths, sums = [], [], [], []
                for ids, at, docs_in, sizes in zip(decode_blocks(part.column(3).to_pylist(), tables), part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    ids = ids.astype("<u4")
                    for doc, n in zip(docs_in, sizes, strict=True):
                        own, ids = ids[:n], ids[n:]
                        names.append(doc)
                        starts.append(at)
                        lengths.append(n)
                        sums.append(zlib.crc32(own))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, starts, lengths, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(F.broadcast(shards), "shard")  # one row for each shard
    rows = placed.select((F.col("shard_start") + F.col("first_id")).alias("at"), "doc_ids", "doc_tokens", "payload")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

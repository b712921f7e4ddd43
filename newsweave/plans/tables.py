"""Tables of a streaming job that change together: hash buckets in folders, one small snapshot file per committed batch.

A table's rows lie in buckets by the hash of its key; a snapshot names, for each table, the folders of each bucket.
A batch writes new folders for the buckets it changes and then one snapshot file, so readers see all tables of complete
batches only, a failed batch leaves nothing that is read, and a batch that is repeated after its commit does nothing. The size of a
snapshot depends on the number of tables and buckets, not on rows or batches: a bucket of more than ``MAX_PARTS``
folders is rewritten as one by the next append. Folders that neither the present nor the last snapshot names are
deleted after a commit, so a reader may lag one batch behind.

One job writes at a time: a batch that finds another's commit since it began fails and has to be repeated.

Updates join the old rows of changed buckets only; where a batch's keys are few enough to be broadcast (rows and
bytes are checked) the old rows are not exchanged at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsweave.plans.durable import broadcast_if_small, durable

MAX_PARTS = 8
MAX_BROADCAST_KEYS = 500_000
SLICES = 1024
BUCKET = "bucket_no"


class Tables:
    """A folder of tables. ``layouts`` names each table's key columns, its number of buckets and, if those are not all keys, the columns that are hashed."""

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, tuple]):
        self.spark, self.root, self.layouts = spark, root, layouts
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(f.getPath().getName() for f in self._store.listStatus(place)) if self._store.exists(place) else []

    def _delete(self, folder: str) -> None:
        self._store.delete(self._path(folder), True)

    def snapshot(self) -> dict:
        """The last committed snapshot: ``version, batches, tables``."""
        versions = [n for n in self._names(f"{self.root}/snapshots") if n.endswith(".json")]
        if not versions:
            return {"version": 0, "batches": {}, "tables": {}}
        stream = self._store.open(self._path(f"{self.root}/snapshots/{versions[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def committed(self, job: str, batch_id: int) -> bool:
        return self.snapshot()["batches"].get(job, -1) >= batch_id

    def read(self, name: str, buckets: Iterable[int] | None = None, snapshot: dict | None = None) -> DataFrame | None:
        """The rows of a table, of some buckets only if they are named; ``None`` before its first batch."""
        found = (snapshot or self.snapshot())["tables"].get(name)
        if found is None:
            return None
        schema = StructType.fromJson(found["schema"])
        chosen = found["parts"] if buckets is None else {str(b): found["parts"].get(str(b), []) for b in buckets}
        paths = [f"{self.root}/{part}" for b in sorted(chosen, key=int) for part in chosen[b]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, name: str) -> Column:
        """The bucket of a row."""
        keys, n, *hashed = self.layouts[name]
        return F.pmod(F.hash(*(hashed[0] if hashed else keys)), F.lit(n))

    def buckets_of(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that hold the keys of ``rows``: at most the table's number of buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())

    def batch(self, job: str, batch_id: int) -> Batch:
        return Batch(self, job, batch_id)


class Batch:
    """The changes of one batch, as a context: committed together at its end, dropped if it fails.

    Reads show the changes made so far. ``skipped`` is true if the batch was committed before; its changes are then ignored.
    """

    def __init__(self, tables: Tables, job: str, batch_id: int):
        self.tables, self.job, self.batch_id = tables, job, batch_id
        self.state = tables.snapshot()
        self.before = json.loads(json.dumps(self.state))
        self.skipped = self.state["batches"].get(job, -1) >= batch_id
        self.run = f"{job}-{batch_id}-{uuid.uuid4().hex[:8]}"
        self.written: list[str] = []

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and not self.skipped:
            self._commit()
        elif not self.skipped:
            for folder in self.written:
                self.tables._delete(f"{self.tables.root}/{folder}")

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        return self.tables.read(name, buckets, self.state)

    def has(self, name: str) -> bool:
        """Whether the table was ever written."""
        return name in self.state["tables"]

    def _write(self, name: str, rows: DataFrame, replaced: Iterable[int] = ()) -> None:
        """New folders for the buckets of ``rows``; those of ``replaced`` buckets take the place of the old ones.

        Rows of a bucket are dealt over tasks by their values, so a task holds no more of a large batch however few buckets there
        are; adaptive execution makes one task of a small batch.
        """
        folder = f"data/{name}/{self.run}-{len(self.written)}"
        self.written.append(folder)
        out = rows.withColumn(BUCKET, self.tables.bucket(name))
        values = [F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith(("array", "struct", "map", "variant"))]
        out.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*values), F.lit(SLICES))).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.tables.root}/{folder}")
        table = self.state["tables"].setdefault(name, {"schema": json.loads(rows.schema.json()), "parts": {}})
        for b in replaced:
            table["parts"].pop(str(b), None)
        for part in self.tables._names(f"{self.tables.root}/{folder}"):
            if part.startswith(f"{BUCKET}="):
                table["parts"].setdefault(part.split("=")[1], []).append(f"{folder}/{part}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; buckets with too many folders are rewritten as one."""
        if self.skipped:
            return
        self._write(name, rows)
        parts = self.state["tables"][name]["parts"]
        full = [int(b) for b, folders in parts.items() if len(folders) > MAX_PARTS]
        if full:
            self._write(name, self.read(name, full), full)

    def replace(self, name: str, keys: DataFrame, change: Callable[[DataFrame | None], DataFrame]) -> None:
        """Put ``change(old)`` in the place of the old rows that have one of ``keys`` (``None`` in the first batch); other rows stay."""
        if self.skipped:
            return
        columns = list(self.tables.layouts[name][0])
        if not self.has(name):
            self._write(name, change(None))
            return
        wanted = durable(keys.select(*columns).distinct(), "keys")
        touched = self.tables.buckets_of(name, wanted)
        wanted = broadcast_if_small(wanted, MAX_BROADCAST_KEYS)
        old = self.read(name, touched)
        stay = old.join(wanted, columns, "left_anti")
        changed = change(old.join(wanted, columns, "left_semi"))
        self._write(name, stay.unionByName(changed.select(*old.columns)), touched)

    def upsert(self, name: str, updates: DataFrame, order: str, kept: tuple[str, ...] = ()) -> None:
        """Last write wins by ``order`` for each key, as ``dedup.upsert`` does; repeating it changes nothing."""
        from newsweave.operators.dedup import upsert

        keys = list(self.tables.layouts[name][0])
        self.replace(name, updates, lambda old: upsert(updates.limit(0) if old is None else old, updates, keys, order, kept))

    def remove(self, name: str, keys: DataFrame) -> None:
        """Take the rows with these keys out."""
        if self.has(name):
            self.replace(name, keys, lambda old: old.limit(0))

    def _commit(self) -> None:
        tables, state = self.tables, self.state
        if tables.snapshot()["version"] != self.before["version"]:
            raise RuntimeError("another job has committed since this batch began; repeat it")
        state["version"] += 1
        state["batches"][self.job] = self.batch_id
        place = f"{tables.root}/snapshots"
        draft = tables._path(f"{place}/.{self.run}")
        out = tables._store.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not tables._store.rename(draft, tables._path(f"{place}/{state['version']:012d}.json")):
            raise RuntimeError("another job has committed this version")
        for name in [n for n in tables._names(place) if n.endswith(".json")][:-2]:
            tables._delete(f"{place}/{name}")
        self._clean()

    def _clean(self) -> None:
        tables = self.tables
        used = {p for s in (self.state, self.before) for t in s["tables"].values() for parts in t["parts"].values() for p in parts}
        runs = {p.rsplit("/", 1)[0] for p in used}
        for name in self.state["tables"]:
            for run in tables._names(f"{tables.root}/data/{name}"):
                folder = f"data/{name}/{run}"
                if folder not in runs:
                    tables._delete(f"{tables.root}/{folder}")
                    continue
                for part in tables._names(f"{tables.root}/{folder}"):
                    if part.startswith(f"{BUCKET}=") and f"{folder}/{part}" not in used:
                        tables._delete(f"{tables.root}/{folder}/{part}")

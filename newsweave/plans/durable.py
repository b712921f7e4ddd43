"""Intermediate results that survive the loss of an executor, and broadcasts of checked size."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 64 << 20

#: Folders of the durable tables of the innermost open ``scratch``; None outside of any.
_written: contextvars.ContextVar[dict[str, bool] | None] = contextvars.ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only a local master without one gets a temporary folder; on a cluster that is an error, because every
    executor would write to its own disk.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="newsweave-"))
        found = context.getCheckpointDir()
    return found


def durable(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, which cuts its lineage.

    ``replaces`` is an earlier durable table that nothing needs any more; it is deleted once the new one is complete.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if replaces is not None and getattr(replaces, "durable_path", None):
        delete_folder(spark, replaces.durable_path)
    folders = _written.get()
    if folders is not None:
        folders[path] = False
    written = spark.read.schema(df.schema).parquet(path)
    written.durable_path = path
    return written


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose durable tables are deleted at its end, also when it raises.

    The block gets a function that marks a durable table as kept and returns it: whatever a result is still read
    from. Kept tables belong to the block around, if there is one, which may keep or delete them in its turn.
    """
    around, folders = _written.get(), {}

    def keep(table: DataFrame) -> DataFrame:
        folders[table.durable_path] = True
        return table

    token = _written.set(folders)
    done = False
    try:
        yield keep
        done = True
    finally:
        _written.reset(token)
        for path, kept in folders.items():
            if not (kept and done):
                delete_folder(spark, path)
            elif around is not None:
                around.setdefault(path, False)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder from whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            inner = F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(0).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType))
            return inner + 24
        return F.greatest(F.size(column), F.lit(0)) * 8 + 24
    if isinstance(kind, T.StructType):
        return sum((value_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a count proves at most ``max_rows`` rows and ``max_bytes`` bytes of values; ``df`` must be cheap to count."""
    width = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where ``is_small`` holds (for a durable table). Larger sides are left to a shuffled join."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df

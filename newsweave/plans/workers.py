"""Prepares a session for Python workers: the package is importable there, and Arrow batches of texts stay small."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def workers_import(spark: SparkSession) -> None:
    """Put the folder above this package on the workers' path; on a cluster ship it with ``--py-files`` as usual.

    Arrow batches are held outside of the heap, by the executor and by its workers: ten thousand texts are tens of
    megabytes several times over, so a batch takes ``BATCH_ROWS`` rows unless the session has fewer.
    """
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    here = str(Path(__file__).resolve().parents[2])
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *paths])

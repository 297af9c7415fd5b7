"""Bounded Arrow batches for tables of texts, and workers that give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch. Texts are a few kilobytes; Spark's default of 10,000 rows would hold tens
#: of megabytes in the JVM and again in each Python worker.
ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size, never raises it."""
    now = int(spark.conf.get(_KEY, "10000"))
    if not 0 < now <= ROWS:
        spark.conf.set(_KEY, str(ROWS))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches after which its worker returns what it has freed to the system. Workers live on
    through later stages, and their memory counts beside the executor's heap."""
    @wraps(run)
    def trimmed(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return trimmed

"""Python workers live on between tasks; these give back what a task has freed."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


#: Bytes of an Arrow batch on its way to a worker; rows of texts or sets would fill the default of 64 MB.
BATCH, SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for JVM and workers, unless the session has a lower bound already."""
    if int(str(spark.conf.get(SETTING, str(64 << 20))).rstrip("b")) > BATCH:
        spark.conf.set(SETTING, str(BATCH))


def release() -> None:
    """Return freed memory of Arrow's pool and of the C heap to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that releases memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable[..., pa.Table], *args: object) -> pa.Table:
    """One group's result, with memory released before it is sent."""
    out = run(*args)
    release()
    return out

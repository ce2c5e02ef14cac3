"""Streaming forms: catalogs that arrive as files feed running spectra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from voxelweave.operators.spectra import bin_index


def catalog_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet catalogs under ``path`` as they come."""
    return spark.readStream.schema(schema).parquet(path)


def running_histogram(stream: DataFrame, col: str, edges: list[float], time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per size bin; with ``time``, per event-time window behind a watermark."""
    rows = stream.withColumn("bin", bin_index(F.col(col).cast("double"), edges)).where("bin IS NOT NULL")
    if time is None:
        return rows.groupBy("bin").agg(F.count("*").alias("n"))
    return rows.withWatermark(time, late).groupBy(F.window(time, window), "bin").agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Run a batch operator on every micro-batch."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True)

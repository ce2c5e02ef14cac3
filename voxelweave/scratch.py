"""Intermediate tables in the folder that driver and executors share.

Iterative and multi-stage operators cut their lineage here instead of keeping blocks on
executors, so a lost executor costs a re-read and never a recomputation of the whole chain.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark removes a query's shuffle files when the query has ended; a written table does not need them any more.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is configured, one of this machine's is made, in local mode only."""
    there = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="voxelweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        there = f"file://{own}"
        spark.conf.set(SETTING, there)
    return there.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds for a while; its former value comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables of one operator run: ``keep`` writes and re-reads a frame, ``drop`` removes what is no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/voxelweave/{label}-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` as Parquet and read it back under its own schema (safe for empty frames)."""
        with setting(self.spark, SHUFFLE_CLEANUP, "true"):
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str, n: int, dealt: bool = False, codec: str = "snappy") -> DataFrame:
        """Write ``df`` hash-bucketed on ``key``; joins and cogroups of two such tables need no exchange.

        ``dealt``: every partition of ``df`` holds few values of ``key`` already, so it is written as it is.
        """
        table = f"vw_{uuid.uuid4().hex[:16]}"
        with setting(self.spark, SHUFFLE_CLEANUP, "true"):
            (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("compression", codec).option("path", self.path(name)).format("parquet").saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def release(self) -> None:
        """Let Spark delete shuffle files of frames that are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete the named tables (with their catalog entries), or everything when no name is given."""
        for name in names or list(self.tables):
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for where in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(conf).delete(path, True)

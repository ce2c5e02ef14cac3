"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelweave.scratch import Scratch


def numbered(df: DataFrame, col: str, name: str) -> DataFrame:
    """Add ``name``: 1-based number of each row in the order of ``col`` (distinct values), as bigint.

    Rows are range-parted and written once, numbered inside their part, and shifted by the counts of the parts
    before (one row a part), so no task sorts more than its part.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = Scratch(spark, "ranks").keep(df.repartitionByRange(parts, col).withColumn("part_", F.spark_partition_id()), "rows")
    counts = dealt.groupBy("part_").agg(F.count("*").alias("c_"))
    before = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select("part_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("shift_"))
    local = F.row_number().over(W.partitionBy("part_").orderBy(col))
    return dealt.withColumn("local_", local).join(F.broadcast(shift), "part_").select(*df.columns, (F.col("local_") + F.col("shift_")).alias(name))

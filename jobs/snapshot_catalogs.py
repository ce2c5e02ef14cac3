"""Structure catalogs by snapshot, kept up to date as files of measurements arrive.

    python -m jobs.snapshot_catalogs --source DIR --out DIR --checkpoint DIR [--config FILE]

A measurement has a place (three integer keys, taken modulo the cells an axis), a time, a mass and a heat. A snapshot is
a calendar year; a cell of it is cold if its mean heat is below a limit; a structure is a face-connected set of cold
cells on the periodic grid. What is kept:

* ``OUT/cells/step=/batch=``: sums of each batch of new files by snapshot and cell, all that later batches need;
* ``OUT/catalog/step=``: one row a structure (``clump``: its smallest cell) with size, mass, box and exposed area.

The stream's checkpoint knows the files that were taken. A batch adds its sums, then labels again, in one contraction,
just those snapshots that got rows. Both tables are written by dynamic partition overwrite under names that depend on
the batch alone, so a batch that is repeated after a failure writes the same rows over the same partitions. Sums are
decimals: their order does not matter.

Cases: rows without place, time, mass or heat are counted in the log and left out, as are dates before year 1; an empty
source, or one without new files, changes nothing; a snapshot whose cells are all warm has one row without ``clump``,
so that what it had before is replaced (``read_catalog`` leaves it out); files must not change once they are there.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line_session, fresh_folder, settings
from voxelweave.operators import catalog as C
from voxelweave.operators import grid, labels
from voxelweave.scratch import Scratch, path_exists

log = logging.getLogger("jobs.snapshot_catalogs")
DECIMAL = "decimal(38,6)"


@dataclass(frozen=True)
class Settings:
    """``below``: limit of a cold cell's mean heat. ``files_a_batch``: new files taken together at most."""

    cells: int = 8
    place: tuple[str, str, str] | list[str] = ("l_orderkey", "l_partkey", "l_suppkey")
    time: str = "l_shipdate"
    mass: str = "l_quantity"
    heat: str = "l_discount"
    below: float = 0.0451
    files_a_batch: int = 1000


def cell_sums(rows: DataFrame, s: Settings) -> DataFrame:
    """``step, i, j, k, n, mass, heat``: exact sums of the measurements of each snapshot and cell."""
    keys = [F.pmod(F.col(c).cast("bigint"), F.lit(s.cells)).cast("int").alias(a) for c, a in zip(s.place, "ijk", strict=True)]
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast(DECIMAL)
    good = rows.where(_good(s))
    return good.groupBy(F.year(s.time).alias("step"), *keys).agg(F.count("*").alias("n"), exact(s.mass).alias("mass"), exact(s.heat).alias("heat"))


def _good(s: Settings):
    there = F.lit(True)
    for c in (*s.place, s.time, s.mass, s.heat):
        there = there & F.col(c).isNotNull()
    number = [~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < 1e20) for c in (s.mass, s.heat)]
    return F.coalesce(there & number[0] & number[1] & (F.year(s.time) > 0), F.lit(False))


def catalog(sums: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """``step, clump, cell_count, volume, mass``, box and ``area`` of every structure in cells with sums, all snapshots at once."""
    spacing = (1.0 / s.cells,) * 3
    total = sums.groupBy("step", "i", "j", "k").agg(*(F.sum(c).alias(c) for c in ("n", "mass", "heat")))
    cold = total.where(F.col("heat") < F.col("n") * F.lit(s.below).cast("decimal(12,6)")).select("step", "i", "j", "k", F.col("mass").alias("dens"))
    cold = scratch.keep(cold, "cold")
    named = cold.withColumn("cell_id", grid.cell_id(s.cells)).join(labels.snapshot_labels(cold, s.cells, "step", scratch=scratch), ["step", "cell_id"])
    named = scratch.keep(named.withColumnRenamed("root", "clump"), "named")
    key = F.struct("step", "clump").alias("key")
    inner = grid.face_pairs(named, s.cells, ("clump",), by=("step",)).where("src_clump = dst_clump").select(F.struct("step", F.col("src_clump").alias("clump")).alias("key"), "axis")
    rows = named.select(key, "i", "j", "k", "dens")
    count, volume, _ = C.size_aggregates(spacing)
    mass = (F.sum("dens").cast("double") * (1.0 / s.cells**3)).alias("mass")  # summed as decimals
    sizes = rows.groupBy("key").agg(count, volume, mass, *C.bbox_aggregates())
    return sizes.join(C.exposed_area(rows, inner, spacing, "key"), "key").select("key.*", *sizes.columns[1:], "area")


def take(batch: DataFrame, number: int, out: str, s: Settings) -> None:
    """One batch of new files: its sums, then the catalogs of the snapshots that it touches."""
    spark = batch.sparkSession
    scratch = Scratch(spark, "snapshots")
    fresh = scratch.keep(cell_sums(batch, s).withColumn("batch", F.lit(number)), "fresh")
    rows, good = batch.count(), fresh.agg(F.sum("n")).first()[0] or 0  # the first reads no column
    log.info("batch %d: read %d rows, %d of them without place, time, mass or heat", number, rows, rows - good)
    if not good:
        return
    # in order of snapshot and cell: a file a snapshot or two, and no snapshot of many cells in one task
    _overwrite(fresh.repartitionByRange("step", "i", "j", "k"), f"{out}/cells", "step", "batch")
    cells = spark.read.parquet(f"{out}/cells")
    steps = cells.where(F.col("batch") == number).select("step").distinct()
    touched = cells.join(F.broadcast(steps), "step")  # some thousand years at most; prunes partitions
    found = catalog(touched, s, scratch)
    every = steps.join(found, "step", "left")
    _overwrite(every.repartitionByRange("step", F.coalesce("clump", F.lit(-1))), f"{out}/catalog", "step")
    scratch.drop()
    wrote = read_catalog(spark, out).join(F.broadcast(steps), "step").groupBy("step").agg(F.count("*").alias("n")).orderBy("step").collect()
    log.info("batch %d: wrote catalogs of %s", number, ", ".join(f"{r['step']} ({r['n']} structures)" for r in wrote) or "no structure")


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_catalog(spark: SparkSession, out: str) -> DataFrame:
    """The catalogs as they stand."""
    return spark.read.parquet(f"{out}/catalog").where("clump IS NOT NULL")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, s: Settings | None = None) -> int:
    """Take what is new under ``source`` (a folder, or a pattern, of Parquet files); returns the number of batches. Ends when all of it is taken."""
    s = s or Settings()
    schema = spark.read.parquet(source).schema
    columns = [*s.place, s.time, s.mass, s.heat]
    if missing := sorted(set(columns) - set(schema.names)):
        raise KeyError(f"{source} has no {', '.join(missing)}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", s.files_a_batch).parquet(source).select(*columns)
    taken: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        take(batch, number, out, s)
        taken.append(number)

    log.info("looking for new files under %s", source)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("took %d batches; catalogs are under %s/catalog", len(taken), out)
    return len(taken)


def job1_snapshot_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: two runs over the whole table into one new folder, and the catalogs after the second."""
    where = fresh_folder(spark, "snapshot_catalogs")
    for _ in range(2):
        run(spark, f"{sf_dir}/lineitem*.parquet", f"{where}/out", f"{where}/checkpoint")
    return read_catalog(spark, f"{where}/out").drop("volume").withColumns({"step": F.col("step").cast("bigint"), "mass": F.round("mass", 4), "area": F.round("area", 6)})


SQL = """
    WITH RECURSIVE t AS (SELECT year(l_shipdate) AS step, l_orderkey % 8 AS i, l_partkey % 8 AS j, l_suppkey % 8 AS k, count(*) AS n,
                  sum(CAST(l_quantity AS DECIMAL(28, 6))) AS mass, sum(CAST(l_discount AS DECIMAL(28, 6))) AS heat FROM lineitem GROUP BY ALL),
         fg AS (SELECT *, (i * 8 + j) * 8 + k AS id FROM t WHERE heat < n * 0.0451),
         o AS (SELECT unnest([{'x': 1, 'y': 0, 'z': 0}, {'x': 0, 'y': 1, 'z': 0}, {'x': 0, 'y': 0, 'z': 1}]) AS o),
         p AS (SELECT a.step, a.id AS src, b.id AS dst FROM fg a, o JOIN fg b ON b.step = a.step AND b.i = (a.i + o.o.x) % 8 AND b.j = (a.j + o.o.y) % 8 AND b.k = (a.k + o.o.z) % 8),
         e AS (SELECT step, src AS s, dst AS d FROM p UNION SELECT step, dst, src FROM p),
         r(step, id, lab) AS (SELECT step, id, id FROM fg UNION SELECT e.step, e.d, r.lab FROM r JOIN e ON e.step = r.step AND e.s = r.id WHERE r.lab < e.d),
         l AS (SELECT step, id, min(lab) AS clump FROM r GROUP BY step, id),
         x AS (SELECT fg.*, l.clump FROM fg JOIN l USING (step, id)),
         q AS (SELECT x.step, x.clump, count(*) AS pairs FROM p JOIN x ON x.step = p.step AND x.id = p.src GROUP BY ALL)
    SELECT x.step, x.clump, count(*) AS cell_count, round(CAST(sum(mass) AS DOUBLE) / 512, 4) AS mass,
           CAST(min(i) AS BIGINT) AS i_min, CAST(max(i) + 1 AS BIGINT) AS i_max, CAST(min(j) AS BIGINT) AS j_min, CAST(max(j) + 1 AS BIGINT) AS j_max, CAST(min(k) AS BIGINT) AS k_min, CAST(max(k) + 1 AS BIGINT) AS k_max,
           round((6 * count(*) - 2 * coalesce(any_value(q.pairs), 0)) / 64.0::DOUBLE, 6) AS area
    FROM x LEFT JOIN q USING (step, clump) GROUP BY x.step, x.clump"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--source", required=True, help="folder (or pattern) of Parquet files with measurements")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", help="settings (JSON)")
    a = p.parse_args()
    spark = command_line_session("snapshot_catalogs")
    try:
        run(spark, a.source, a.out, a.checkpoint, settings(spark, Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

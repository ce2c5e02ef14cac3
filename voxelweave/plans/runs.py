"""Whole runs: voxels to stitched catalog to spectra, for one snapshot or a sweep of settings."""

from __future__ import annotations

import argparse
import time
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.config import EngineConfig
from voxelweave.operators import catalog as C
from voxelweave.operators import derive, grid, labels, mergetree, ml
from voxelweave.operators import spectra as S
from voxelweave.operators.components import connected_components
from voxelweave.scratch import Scratch, path_exists
from voxelweave.sources import readers, sinks
from voxelweave.sources.parts import brick_index, check_planes, open_run, read_npz_catalog, read_npz_planes, read_parts


def foreground(voxels: DataFrame, config: EngineConfig) -> DataFrame:
    """Derived fields and the cut."""
    return derive.cut(derive.with_primitives(voxels, config.gamma), config.cut_by, config.cut_op, config.threshold)


def run_catalog(spark: SparkSession, voxels: DataFrame, config: EngineConfig, out: str | None = None) -> DataFrame:
    """The stitched catalog of one snapshot (``gid`` and its reductions).

    With ``out``, parts, planes and metadata of each brick are written there (``sources.parts``), then the catalog with its
    settings. A run that fails leaves the run before it whole; the next attempt at the same settings labels and writes
    only the bricks that are missing.
    """
    scratch, began = Scratch(spark, "run"), time.time()
    run = open_run(spark, out, config) if out else None
    full, loaded = labelled_cells(voxels, config, scratch, run.done(spark) if run else None)
    labelled = time.time()
    parts = scratch.keep(C.unstitched_catalog(full, config.n, config.dims, config.spacing), "parts")
    if run:
        planes = labels.face_planes(full, grid.brick_table(spark, config.n, config.dims, config.periodic))
        run.write(parts, planes, {"load": loaded - began, "label": labelled - loaded, "reduce": time.time() - labelled})
        run.complete(spark)
        parts, planes, bricks, _ = read_parts(spark, out)
        merged = stitch_parts(parts, planes, bricks, config.spacing, config.min_clump_cells)
    else:
        edges = scratch.keep(labels.interface_edges(full, config.n, config.dims, config.periodic), "edges")
        merged = C.stitched_catalog(parts, labels.stitched_roots(full, edges), edges, config.spacing, config.min_clump_cells).withColumnRenamed("root", "gid")
    merged = merged.withColumns({"step": F.lit(config.step), "threshold": F.lit(float(config.threshold))}).orderBy("gid")
    if run:
        sinks.write_catalog(merged, out, config)
        scratch.drop()
        return spark.read.parquet(f"{out}/data")
    return merged


def labelled_cells(voxels: DataFrame, config: EngineConfig, scratch: Scratch, done: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Foreground cells with their fields and brick-local labels, written once for all that reads them, and the time when
    the cells were loaded. Cells of bricks in ``done`` (``rank``) are left out."""
    cells = foreground(voxels, config).withColumn("cell_id", grid.cell_id(config.n))
    if done is not None:
        cells = grid.with_brick(cells, config.n, config.dims).join(F.broadcast(done), "rank", "left_anti").drop("rank", "ci", "cj", "ck")
    cells = scratch.keep(cells, "cells")
    loaded = time.time()
    local = labels.brick_labels(cells, config.n, config.dims).drop("i", "j", "k")
    return scratch.keep(cells.join(local, "cell_id"), "labelled"), loaded


def stitch_parts(parts: DataFrame, planes: DataFrame, bricks: DataFrame, spacing: tuple[float, float, float], min_cells: int = 1) -> DataFrame:
    """The merged catalog of a run's parts (see ``sources.parts``), by their boundary planes alone, in order of ``gid``."""
    edges = Scratch(parts.sparkSession, "stitch").keep(labels.plane_edges(planes, bricks), "edges")
    pairs = edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    roots = connected_components(pairs, parts.select(F.col("gid").alias("id"))).withColumnRenamed("id", "gid")
    return C.stitched_catalog(parts, roots, edges, spacing, min_cells).withColumnRenamed("root", "gid").orderBy("gid")


def run_stitch(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Stitch a folder of parts: of this engine, or NPZ files with their sidecars."""
    if path_exists(spark, f"{path}/manifest"):
        parts, planes, bricks, meta = read_parts(spark, path)
    else:
        meta = readers.read_part_index(spark, path)
        bricks = brick_index(meta)
        check_planes(meta, bricks)
        parts, planes = read_npz_catalog(spark, path), read_npz_planes(spark, path)
    g = meta.select("grid.dx", "grid.dy", "grid.dz").first()
    merged = stitch_parts(parts, planes, bricks, (g[0], g[1], g[2]))
    if out:
        merged.write.mode("overwrite").parquet(out)
        return spark.read.parquet(out)
    return merged


def summaries(catalog: DataFrame, n_bins: int = 60) -> dict[str, DataFrame]:
    """Spectrum and correlations of a catalog; nothing for an empty one."""
    lo, hi = catalog.agg(F.min("cell_count"), F.max("cell_count")).first()
    if lo is None:
        return {}
    edges = [float(x) for x in S.integer_edges(lo, hi + 1, n_bins)]
    names = list(ml.DEFAULT_FEATURES)
    return {"spectrum": S.size_spectrum(S.sizes(catalog), "size", edges), "correlations": ml.pearson(ml.features(catalog, names), names)}


def run_directory(spark: SparkSession, root: str, out: str, n_bins: int = 60, least_step: int = 30) -> list[str]:
    """Summaries of every catalog that ``readers.discover_snapshots`` finds under ``root``, each under its own folder of
    ``out``; returns those folders."""
    done = []
    for r in readers.discover_snapshots(spark, root, least_step).orderBy("step", "path").collect():
        where = f"{out}/step{r['step']:05d}"
        catalog = spark.read.parquet(r["path"])
        for name, df in summaries(catalog, n_bins).items():
            df.write.mode("overwrite").parquet(f"{where}/{name}")
        done.append(where)
    return done


def feature_outputs(catalog: DataFrame, names: list[str], out: str, k: int = 3) -> None:
    """Tables of a feature analysis: ``pca_scores``, ``pca_components`` (with explained ratios), ``embedding`` and
    ``histograms`` (joint, of every pair with 50 positive values or more on either side, on log edges)."""
    spark = catalog.sparkSession
    table = ml.features(catalog, names, ("gid",))
    scores, parts, ratio = ml.pca(table, names, k, ("gid",))
    scores.write.mode("overwrite").parquet(f"{out}/pca_scores")
    rows = [(i + 1, float(r), n, float(w)) for i, (r, p) in enumerate(zip(ratio, parts, strict=True)) for n, w in zip(names, p, strict=True)]
    spark.createDataFrame(rows, "component int, ratio double, feature string, loading double").coalesce(1).write.mode("overwrite").parquet(f"{out}/pca_components")
    ml.embedding(table, names, ("gid",)).write.mode("overwrite").parquet(f"{out}/embedding")
    limits = table.agg(*(f(F.when(S.positive(n), F.col(n))).alias(f"{s}_{n}") for n in names for s, f in (("lo", F.min), ("hi", F.max), ("n", F.count)))).first()
    edges = {n: S.log_edges(limits[f"lo_{n}"], limits[f"hi_{n}"], 60) for n in names if limits[f"n_{n}"] >= 50 and limits[f"hi_{n}"] > limits[f"lo_{n}"]}
    if len(edges) > 1:
        S.pair_histograms(table, edges).write.mode("overwrite").parquet(f"{out}/histograms")


def sweep_catalogs(cells: DataFrame, n: int, field: str, thresholds: list[float], spacing: tuple[float, float, float], below: bool = True) -> DataFrame:
    """``threshold, root`` and the catalog of each structure at every threshold of one field, from one contraction.

    ``cells`` are voxels with derived fields. Cells that no threshold takes are left out first; the merge forest of the
    others labels all thresholds together, and one aggregation reduces them.
    """
    scratch = Scratch(cells.sparkSession, "sweep")
    value, far = F.col(field).cast("double"), max(thresholds) if below else min(thresholds)
    some = scratch.keep(cells.where(value < far if below else value > far).withColumn("cell_id", grid.cell_id(n)), "cells")
    forest = scratch.keep(mergetree.merge_forest(some, n, field, below, scratch=scratch), "forest")
    named = scratch.keep(some.join(mergetree.threshold_labels(some, forest, n, field, thresholds, below, scratch), "cell_id"), "named")
    return C.direct_catalog(named, n, spacing, "root", ("level",)).withColumn("threshold", F.array(*(F.lit(float(t)) for t in thresholds))[F.col("level")]).drop("level")


def run_sweep(spark: SparkSession, voxels: DataFrame, configs: list[EngineConfig]) -> DataFrame:
    """Stitched catalogs of several settings in one table, by ``step`` and ``threshold``; ``gid`` is the smallest cell id.

    Settings that differ in nothing but their threshold are one contraction (``sweep_catalogs``) on a periodic grid with
    face connectivity; others, and open axes, are runs of their own (``run_catalog``, whose ``gid`` is by brick).
    """
    alike: dict[EngineConfig, list[float]] = {}
    for c in configs:
        alike.setdefault(replace(c, threshold=0.0), []).append(float(c.threshold))
    out = []
    for c, thresholds in alike.items():
        if len(thresholds) == 1 or c.connectivity != 6 or not all(c.periodic):
            out += [run_catalog(spark, voxels, replace(c, threshold=t)) for t in thresholds]
            continue
        cells = derive.with_primitives(voxels, c.gamma)
        found = sweep_catalogs(cells, c.n, {"temperature": "temp", "density": "dens"}[c.cut_by], thresholds, c.spacing, c.cut_op == "lt")
        found = found.withColumnRenamed("root", "gid").withColumn("step", F.lit(c.step))
        out.append(found.where(F.col("cell_count") >= c.min_clump_cells))
    return reduce(DataFrame.unionByName, out)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", help="settings (YAML) of a whole run")
    p.add_argument("--voxels", help="voxel table (Parquet) of a whole run")
    p.add_argument("--stitch", help="folder of parts to merge instead")
    p.add_argument("--catalogs", help="folder of step folders with stitched catalogs to summarise instead")
    p.add_argument("--out", required=True)
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    if a.stitch:
        run_stitch(spark, a.stitch, a.out)
        return
    if a.catalogs:
        run_directory(spark, a.catalogs, a.out)
        return
    if not (a.config and a.voxels):
        p.error("give --config and --voxels, or --stitch, or --catalogs")
    config = EngineConfig.from_yaml(a.config)
    catalog = run_catalog(spark, readers.read_voxels(spark, a.voxels, config.step), config, a.out)
    for name, df in summaries(catalog).items():
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")


if __name__ == "__main__":
    main()

"""Queries over the grid's further structures: clustered layout, runs, the merge forest, boxes on the ring; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import labels, mergetree, pencils, periodic
from voxelweave.operators.grid import gid
from voxelweave.plans import grid_queries as G
from voxelweave.plans import runs
from voxelweave.scratch import Scratch
from voxelweave.sources import layout

N = G.N
LEVELS = [4300.0, 4400.0, 4450.0, 4480.0, 4510.0]


def periodic_slice_scan_clustered(spark, d, n=N):
    """The sub-volume scan, from a table in the clustered layout."""
    where = Scratch(spark, "clustered").path("voxels")
    layout.write_clustered(G.voxels(spark, d, n), where, files=8)
    return layout.periodic_scan(spark.read.parquet(where), n, ((0, 4), (2, 6), (n - 3, n)), 1).select("gi", "gj", "gk", F.col("dens").cast("double").alias("dens"))


def pencil_runs(spark, d, n=N):
    return pencils.cell_runs(G.mask(spark, d, n).select("i", "j", "k"))


def component_labels_runs(spark, d, n=N):
    return pencils.cells_of(pencils.run_labels(G.mask(spark, d, n).select("i", "j", "k"), n), n)


def component_labels_runs_26(spark, d, n=N):
    return pencils.cells_of(pencils.run_labels(G.voxels(spark, d, n).where(F.col("dens") > F.lit(G.DENSE + 60).cast("float")).select("i", "j", "k"), n, 26), n)


def _sweep(spark, d, n) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "sweep")
    cells = scratch.keep(G.voxels(spark, d, n).where(F.col("temp") < max(LEVELS)), "cells")
    forest = scratch.keep(mergetree.merge_forest(cells, n, "temp", scratch=scratch), "forest")
    return cells, mergetree.threshold_labels(cells, forest, n, "temp", LEVELS, scratch=scratch)


def threshold_sweep_labels(spark, d, n=N):
    return _sweep(spark, d, n)[1]


def threshold_sweep_catalog(spark, d, n=N):
    """Catalogs of all settings of a sweep (``runs.sweep_catalogs``)."""
    cells = G.primitive(spark, d, n)
    found = runs.sweep_catalogs(cells, n, "temp", LEVELS, G.spacing(n))
    digits = {"mass": 5, "area": 5, "velocity_mean": 5, "centroid_vol_x": 9}
    return found.select("threshold", "root", "cell_count", *(F.round(c, d).alias(c) for c, d in digits.items()), "i_min", "i_max")


def _extents(planes: DataFrame, n: int) -> DataFrame:
    return G._rounded(periodic.periodic_extents(planes, n, G.spacing(n), "root"))


def clump_bbox_periodic(spark, d, n=N):
    return _extents(periodic.occupied_planes(G.labelled(spark, d, n)[0], "root"), n)


def clump_bbox_periodic_bricks(spark, d, n=N):
    """The same from the planes of brick-local components, merged."""
    scratch = Scratch(spark, "planes")
    cells = scratch.keep(G.mask(spark, d, n).withColumn("cell_id", G.grid.cell_id(n)), "cells")
    local = scratch.keep(cells.join(labels.brick_labels(cells, n, G.DIMS).select("cell_id", "rank", "label_ids"), "cell_id").withColumn("gid", gid()), "local")
    roots = labels.stitched_roots(local, labels.interface_edges(local, n, G.DIMS))
    least = local.groupBy("gid").agg(F.min("cell_id").alias("c")).join(roots, "gid").groupBy("root").agg(F.min("c").alias("least"))
    named = roots.join(least, "root").select("gid", F.col("least").alias("root"))
    return _extents(periodic.merged_planes(periodic.occupied_planes(local, "gid"), named), n)


QUERIES = {
    f.__name__: f
    for f in (
        periodic_slice_scan_clustered, pencil_runs, component_labels_runs, component_labels_runs_26, threshold_sweep_labels, threshold_sweep_catalog,
        clump_bbox_periodic, clump_bbox_periodic_bricks,
    )
}

# ---- SQL ------------------------------------------------------------------------------------------------------------
_HALF = "(VALUES (0, 0, 1), (0, 1, 0), (1, 0, 0)) o(oi, oj, ok)"
_LEVELS = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(LEVELS))
_SWEEP = (
    G.R + G.MASK + f", lv AS (SELECT * FROM (VALUES {_LEVELS}) l(level, t)), c AS (SELECT p.*, sqrt(CAST(velx AS DOUBLE) * CAST(velx AS DOUBLE) + CAST(vely AS DOUBLE) * CAST(vely AS DOUBLE) + CAST(velz AS DOUBLE) * CAST(velz AS DOUBLE)) AS speed FROM prim p), "
    "s AS (SELECT level, t, c.* FROM c JOIN lv ON c.temp < t), "
    f"p AS (SELECT a.level, a.id AS src, b.id AS dst FROM s a CROSS JOIN {_HALF} JOIN s b ON b.level = a.level AND b.i = (a.i + oi) % 16 AND b.j = (a.j + oj) % 16 AND b.k = (a.k + ok) % 16), "
    "e AS (SELECT level, src AS s, dst AS d FROM p UNION SELECT level, dst, src FROM p), "
    "r(level, id, lab) AS (SELECT level, id, id FROM s UNION SELECT e.level, e.d, r.lab FROM r JOIN e ON e.level = r.level AND e.s = r.id WHERE r.lab < e.d), "
    "l AS (SELECT level, id, min(lab) AS root FROM r GROUP BY level, id), "
    "x AS (SELECT s.*, l.root FROM s JOIN l USING (level, id))"
)


def _ring(a: str) -> str:
    x = G.AXIS[a]
    return (
        f", p{x} AS (SELECT root, {a} AS pos, count(*) AS c, sum(CAST(dens AS DOUBLE)) AS m FROM x GROUP BY ALL), "
        f"g{x} AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY root ORDER BY pos), max(pos) OVER (PARTITION BY root) - 16) AS gap FROM p{x}), "
        f"box{x} AS (SELECT root, max(gap) AS gap, CASE WHEN max(gap) = 1 THEN 0 ELSE min(pos) FILTER (gap = top) END AS start FROM (SELECT *, max(gap) OVER (PARTITION BY root) AS top FROM g{x}) GROUP BY root), "
        f"e{x} AS (SELECT root, any_value(start) AS {x}_start, CAST(17 - any_value(gap) AS INTEGER) AS {x}_size, (any_value(start) + sum(((pos - start + 16) % 16 + 0.5::DOUBLE) * c) / sum(c)) AS v, "
        f"(any_value(start) + sum(((pos - start + 16) % 16 + 0.5::DOUBLE) * m) / sum(m)) AS w FROM p{x} JOIN box{x} USING (root) GROUP BY root)"
    )


_BOXES = (
    G.LABELS + "".join(map(_ring, "ijk")) + " SELECT root, " + ", ".join(
        f"{x}_start, {x}_size, round((e{x}.v - 16 * floor(e{x}.v / 16)) / 16, 6) AS centroid_vol_{x}, round((e{x}.w - 16 * floor(e{x}.w / 16)) / 16, 6) AS centroid_mass_{x}" for x in "xyz"
    ) + " FROM ex JOIN ey USING (root) JOIN ez USING (root)"
)
SQL: dict[str, str] = {
    "periodic_slice_scan_clustered": G.SQL["periodic_slice_scan"],
    "pencil_runs": f"WITH {G.MASK}, g AS (SELECT i, j, k, k - row_number() OVER (PARTITION BY i, j ORDER BY k) AS island FROM fg) SELECT i, j, min(k) AS k0, max(k) + 1 AS k1 FROM g GROUP BY i, j, island",
    "component_labels_runs": G.SQL["component_labels"],
    "component_labels_runs_26": G.SQL["component_labels_26"],
    "threshold_sweep_labels": _SWEEP + " SELECT level, id AS cell_id, root FROM x",
    "threshold_sweep_catalog": _SWEEP + ", q AS (SELECT x.level, x.root, count(*) AS n FROM p JOIN x ON x.level = p.level AND x.id = p.src GROUP BY ALL) "
    "SELECT any_value(t) AS threshold, x.root, count(*) AS cell_count, round(sum(CAST(dens AS DOUBLE) / 4096), 5) AS mass, round((6 * count(*) - 2 * coalesce(any_value(q.n), 0)) / 256.0::DOUBLE, 5) AS area, "
    "round(avg(speed), 5) AS velocity_mean, round(avg((i + 0.5::DOUBLE) / 16), 9) AS centroid_vol_x, CAST(min(i) AS BIGINT) AS i_min, CAST(max(i) + 1 AS BIGINT) AS i_max FROM x LEFT JOIN q USING (level, root) GROUP BY x.level, x.root",
    "clump_bbox_periodic": _BOXES,
    "clump_bbox_periodic_bricks": _BOXES,
}

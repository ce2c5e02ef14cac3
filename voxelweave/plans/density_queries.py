"""Queries over nearest positions and density clusters of customers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.operators import density
from voxelweave.scratch import Scratch

HEIGHTS = [0.05, 0.1, 0.2, 0.35, 1.2]
MIN_POINTS = 4
NEIGHBOURS = 6


def _customers(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


def nearest_positions(spark, d):
    """The nearest other positions of every position."""
    scratch = Scratch(spark, "nearest")
    pts = scratch.keep(density.positions(_customers(spark, d), "key", ["x", "y"]), "positions")
    return density.nearest(pts, ["x", "y"], NEIGHBOURS, scratch).where("place > 0").select("id", "place", "n_id", "n_w", F.round(F.sqrt("d2"), 6).alias("distance"))


def density_cuts(spark, d):
    """Clusters of all rows at five heights, from one graph."""
    scratch, rows = Scratch(spark, "density"), _customers(spark, d)
    points, graph = density.reachability_graph(rows, "key", ["x", "y"], MIN_POINTS, scratch)
    return density.rows_of(rows, "key", ["x", "y"], density.clusters_at(points, graph, HEIGHTS, scratch), points)


def density_clusters(spark, d):
    """The most stable clusters over twelve heights, by name, with their sizes."""
    scratch, rows = Scratch(spark, "density"), _customers(spark, d)
    heights = [0.02 * 1.5**i for i in range(12)]
    points, graph = density.reachability_graph(rows, "key", ["x", "y"], MIN_POINTS, scratch)
    levels = density.clusters_at(points, graph, heights, scratch)
    found = density.rows_of(rows, "key", ["x", "y"], density.stable_clusters(levels, heights, 8, scratch=scratch), points)
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.first("stability"), 6).alias("stability"))


QUERIES = {f.__name__: f for f in (nearest_positions, density_cuts, density_clusters)}

# ---- SQL ------------------------------------------------------------------------------------------------------------
_P = "p AS (SELECT c_custkey AS key, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
_LEVELS = ", ".join(f"({i}, {h * h!r}::DOUBLE)" for i, h in enumerate(HEIGHTS))
SQL: dict[str, str] = {
    "nearest_positions": f"WITH {_P}, q AS (SELECT min(key) AS id, count(*) AS w, x, y FROM p GROUP BY x, y), m AS (SELECT a.id, b.id AS n_id, b.w AS n_w, {_D2} AS d2 FROM q a JOIN q b ON a.id <> b.id), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, n_id) AS INTEGER) AS place FROM m) "
    f"SELECT id, place, n_id, n_w, round(sqrt(d2), 6) AS distance FROM r WHERE place <= {NEIGHBOURS}",
    "density_cuts": f"WITH RECURSIVE {_P}, lv AS (SELECT * FROM (VALUES {_LEVELS}) l(level, h)), m AS (SELECT a.key AS s, b.key AS d, {_D2} AS d2 FROM p a JOIN p b ON {_D2} <= {HEIGHTS[-1] ** 2!r}::DOUBLE), "
    "k AS (SELECT level, s AS key FROM m JOIN lv ON d2 <= h GROUP BY level, s HAVING count(*) >= " + str(MIN_POINTS) + "), "
    "e AS (SELECT lv.level, s, d FROM m JOIN lv ON d2 <= h JOIN k a ON a.level = lv.level AND a.key = s JOIN k b ON b.level = lv.level AND b.key = d WHERE s <> d), "
    "r(level, id, lab) AS (SELECT level, key, key FROM k UNION SELECT e.level, e.d, r.lab FROM r JOIN e ON e.level = r.level AND e.s = r.id WHERE r.lab < e.d) "
    "SELECT level, id AS key, min(lab) AS cluster FROM r GROUP BY level, id",
}

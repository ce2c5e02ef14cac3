"""Boxes and centroids that are aware of the wrap-around, from the planes that a structure occupies.

Per structure and axis, the occupied planes with their cells and masses are all that is needed: sums, so they are
combined on the map side and merge exactly over bricks. The box is the complement of the largest gap between occupied
planes on the ring; the centroid is taken from the box's first plane on, where the structure is in one piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def occupied_planes(labelled: DataFrame, key: str) -> DataFrame:
    """``key, axis, at, cells, mass`` (sums of 1 and of ``dens``) of labelled cells: at most 3 n rows a structure."""
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("axis"), F.col(a).cast("int").alias("at")) for a, x in zip("ijk", "xyz", strict=True))))
    rows = labelled.select(key, F.col("dens").cast("double").alias("m_"), sides.alias("p"))
    return rows.groupBy(key, "p.axis", "p.at").agg(F.count("*").alias("cells"), F.sum("m_").alias("mass"))


def merged_planes(planes: DataFrame, roots: DataFrame, key: str = "gid") -> DataFrame:
    """Planes of parts as planes of their ``root``s (``roots``: ``key, root``)."""
    return planes.join(roots, key).groupBy("root", "axis", "at").agg(F.sum("cells").alias("cells"), F.sum("mass").alias("mass"))


def periodic_extents(planes: DataFrame, n: int, spacing: tuple[float, float, float], key: str) -> DataFrame:
    """``key`` and, for each axis: ``{x}_start`` (first plane of the box, 0 to n-1), ``{x}_size`` (planes of the box; a box
    over the rim has start + size > n), ``centroid_vol_{x}`` and ``centroid_mass_{x}`` in [0, n * spacing).

    Of equal largest gaps the one that gives the smallest start is taken; a structure on every plane starts at 0.
    """
    ring = W.partitionBy(key, "axis").orderBy("at")
    every = W.partitionBy(key, "axis")
    before = F.coalesce(F.lag("at").over(ring), F.max("at").over(every) - n)  # the plane before, around the ring
    gaps = planes.withColumn("gap_", F.col("at") - before)
    start = F.min(F.struct((-F.col("gap_")).alias("g"), F.col("at").alias("s"))).over(every)
    placed = gaps.withColumn("b_", start).withColumns({"start": F.when(F.col("b_.g") == -1, F.lit(0)).otherwise(F.col("b_.s")), "gap": -F.col("b_.g")})
    u = F.pmod(F.col("at") - F.col("start"), F.lit(n)) + 0.5
    d = F.element_at(F.create_map(*(F.lit(v) for x, s in zip("xyz", spacing, strict=True) for v in (x, float(s)))), F.col("axis"))
    on_ring = lambda w: F.pmod(F.col("start") + F.sum(u * F.col(w)) / F.sum(w), F.lit(float(n))) * F.col("d_")
    one = placed.withColumn("d_", d).groupBy(key, "axis", "start", "gap", "d_").agg(on_ring("cells").alias("vol"), on_ring("mass").alias("mass_"))
    pick = lambda c, x: F.max(F.when(F.col("axis") == x, F.col(c)))
    out = []
    for x in "xyz":
        out += [pick("start", x).cast("int").alias(f"{x}_start"), (F.lit(n + 1) - pick("gap", x)).cast("int").alias(f"{x}_size"), pick("vol", x).alias(f"centroid_vol_{x}"), pick("mass_", x).alias(f"centroid_mass_{x}")]
    return one.groupBy(key).agg(*out)

"""Per-structure reductions: one pass of algebraic aggregates over labelled cells, and their exact merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.components import connected_components
from voxelweave.operators.derive import centre, pressure, speed
from voxelweave.operators.grid import face_pairs, gid, split_axis
from voxelweave.operators.labels import _ends

TINY = 1e-300
VARIABLES = ("rho", "T", "vx", "vy", "vz", "pressure")
PAIR_BITS = [(a, b) for a in range(6) for b in range(a + 1, 6)]


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def size_aggregates(spacing: tuple[float, float, float]) -> list[Column]:
    """``cell_count, volume, mass``."""
    vc = float(np.prod(spacing))
    return [F.count("*").alias("cell_count"), (F.count("*") * F.lit(vc)).alias("volume"), F.sum(_d("dens") * vc).alias("mass")]


def bbox_aggregates() -> list[Column]:
    """Half-open bounding box, not aware of the wrap-around."""
    return [x for a in "ijk" for x in (F.min(a).cast("bigint").alias(f"{a}_min"), (F.max(a) + 1).cast("bigint").alias(f"{a}_max"))]


def centroid_aggregates(spacing: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> list[Column]:
    """Volume- and mass-weighted centroids."""
    vc, out = float(np.prod(spacing)), []
    for kind, w in (("vol", F.lit(vc)), ("mass", _d("dens") * vc)):
        for a, name, d, o in zip("ijk", "xyz", spacing, origin, strict=True):
            out.append((F.sum(w * centre(a, o, d)) / (F.sum(w) + TINY)).alias(f"centroid_{kind}_{name}"))
    return out


def speed_aggregates() -> list[Column]:
    return [F.avg(speed()).alias("velocity_mean"), F.stddev_pop(speed()).alias("velocity_std")]


def exposed_area(labelled: DataFrame, pairs: DataFrame, spacing: tuple[float, float, float], key: str | list[str]) -> DataFrame:
    """``key, area``: per axis, two faces a cell less two for each internal face pair (``pairs``: key, axis)."""
    face = {"x": spacing[1] * spacing[2], "y": spacing[0] * spacing[2], "z": spacing[0] * spacing[1]}
    keys = [key] if isinstance(key, str) else key
    cells = labelled.groupBy(*keys).agg((F.count("*") * F.lit(2.0 * sum(face.values()))).alias("all_"))
    inner = pairs.groupBy(*keys).agg(F.sum(F.create_map(*(F.lit(v) for a, f in face.items() for v in (a, 2.0 * f)))[F.col("axis")]).alias("inner_"))
    return cells.join(inner, keys, "left").select(*keys, (F.col("all_") - F.coalesce("inner_", F.lit(0.0))).alias("area"))


def internal_pairs(labelled: DataFrame, n: int, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``key, axis``: face pairs inside the periodic grid whose ends have one label (all pairs, by construction); with
    ``by``, in each of several labellings."""
    return face_pairs(labelled, n, (key,), by=by).where(f"src_{key} = dst_{key}").select(*by, F.col(f"src_{key}").alias(key), "axis")


def brick_internal_pairs(labelled: DataFrame, n: int, dims: tuple[int, int, int], key: str) -> DataFrame:
    """The same, without pairs over brick faces."""
    pairs = face_pairs(labelled, n, (key, "i", "j", "k")).where(f"src_{key} = dst_{key}")
    inside = F.lit(True)
    for axis, a, his in zip("xyz", "ijk", _ends(n, dims), strict=True):
        inside = inside & ~((F.col("axis") == axis) & F.col(f"src_{a}").isin([hi - 1 for hi in his]))
    return pairs.where(inside).select(F.col(f"src_{key}").alias(key), "axis")


def moments(labelled: DataFrame, key: str, variables: tuple[str, ...] = VARIABLES, weight: str | None = None, excess: bool = False) -> DataFrame:
    """Population mean, standard deviation, skewness and kurtosis per label, from central sums in two passes.

    ``weight``: a column, or None for equal weights (suffix ``_massw`` is added for ``dens``). Zero variance
    gives zero skewness and kurtosis (-3 as excess). The means come back by a join, not a window, so a label
    that holds most cells is combined on the map side.
    """
    rows = labelled.withColumn("pressure", pressure()) if "pressure" in variables and "pressure" not in labelled.columns else labelled
    w = _d(weight) if weight else F.lit(1.0)
    suffix = "_massw" if weight else ""
    means = rows.groupBy(key).agg((F.sum(w)).alias("w_"), *((F.sum(w * _d(v)) / F.sum(w)).alias(f"mu_{v}") for v in variables))
    both = rows.join(means, key)
    central = both.groupBy(key).agg(F.first("w_").alias("w_"), *(F.first(f"mu_{v}").alias(f"mu_{v}") for v in variables), *(F.sum(w * F.pow(_d(v) - F.col(f"mu_{v}"), F.lit(p))).alias(f"m{p}_{v}") for v in variables for p in (2, 3, 4)))
    out = [F.col(key)]
    for v in variables:
        var = F.col(f"m2_{v}") / F.col("w_")
        sd = F.sqrt(var)
        out += [
            F.col(f"mu_{v}").alias(f"{v}_mean{suffix}"), sd.alias(f"{v}_std{suffix}"),
            (F.col(f"m3_{v}") / F.col("w_") / (sd * sd * sd + TINY)).alias(f"{v}_skew{suffix}"),
            (F.col(f"m4_{v}") / F.col("w_") / (var * var + TINY) - (3.0 if excess else 0.0)).alias(f"{v}_kurt{suffix}"),
        ]
    return central.select(*out)


def second_moments(labelled: DataFrame, key: str, spacing: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Mass-weighted covariance of position: ``cxx, cyy, czz, cxy, cxz, cyz``, about each label's centroid."""
    w = _d("dens") * float(np.prod(spacing))
    at = {n: centre(a, o, d) for a, n, d, o in zip("ijk", "xyz", spacing, origin, strict=True)}
    means = labelled.groupBy(key).agg(F.sum(w).alias("w_"), *((F.sum(w * x) / (F.sum(w) + TINY)).alias(f"mu_{n}") for n, x in at.items()))
    both = labelled.join(means, key)
    off = {n: x - F.col(f"mu_{n}") for n, x in at.items()}
    return both.groupBy(key).agg(*((F.sum(w * off[a] * off[b]) / (F.first("w_") + TINY)).alias(f"c{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")))


def principal_axes(moments2: DataFrame, key: str) -> DataFrame:
    """Axis lengths (descending), ratios b/a and c/a and the orientation (columns are axes, row-major) of ``second_moments``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            m = np.empty((len(t), 3, 3))
            for a, b, name in ((0, 0, "cxx"), (1, 1, "cyy"), (2, 2, "czz"), (0, 1, "cxy"), (0, 2, "cxz"), (1, 2, "cyz")):
                m[:, a, b] = m[:, b, a] = t[name]
            value, vector = np.linalg.eigh(m)
            value, vector = value[:, ::-1], vector[:, :, ::-1]
            size = np.sqrt(np.maximum(value, 0))
            yield pd.DataFrame({key: t[key], "axis_a": size[:, 0], "axis_b": size[:, 1], "axis_c": size[:, 2], "ratio_ba": size[:, 1] / (size[:, 0] + TINY), "ratio_ca": size[:, 2] / (size[:, 0] + TINY), "orientation": list(vector.reshape(len(t), 9))})

    return moments2.mapInPandas(run, f"{key} bigint, axis_a double, axis_b double, axis_c double, ratio_ba double, ratio_ca double, orientation array<double>")


def face_flags(box: str = "") -> list[Column]:
    """Whether a label touches its box's faces, in the order x-, x+, y-, y+, z-, z+ (needs ``i0 .. k1``)."""
    return [F.bool_or(F.col(a) == (F.col(f"{a}0") if side == "neg" else F.col(f"{a}1") - 1)).alias(f"{name}_{side}") for a, name in zip("ijk", "xyz", strict=True) for side in ("neg", "pos")]


def face_pair_bits() -> Column:
    """Bit set of the 15 pairs of touched faces, lexicographic."""
    names = [f"{n}_{s}" for n in "xyz" for s in ("neg", "pos")]
    bits = [F.when(F.col(names[a]) & F.col(names[b]), F.lit(1 << i)).otherwise(F.lit(0)) for i, (a, b) in enumerate(PAIR_BITS)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total.cast("int")


def direct_catalog(labelled: DataFrame, n: int, spacing: tuple[float, float, float], key: str = "root", by: tuple[str, ...] = ()) -> DataFrame:
    """Catalog of labelled cells on the periodic grid, in one aggregation plus the face count; ``by``: columns that tell
    several labellings apart."""
    base = labelled.groupBy(*by, key).agg(*size_aggregates(spacing), *centroid_aggregates(spacing), *speed_aggregates(), *bbox_aggregates())
    return base.join(exposed_area(labelled, internal_pairs(labelled, n, key, by), spacing, [*by, key]), [*by, key])


def unstitched_catalog(labelled: DataFrame, n: int, dims: tuple[int, int, int], spacing: tuple[float, float, float]) -> DataFrame:
    """One row per local component: ``gid, rank, label_ids`` and its reductions; box faces count as exposed."""
    rows = labelled.withColumn("gid", gid())
    base = rows.groupBy("gid", "rank", "label_ids").agg(*size_aggregates(spacing), *centroid_aggregates(spacing), *speed_aggregates(), *bbox_aggregates())
    return base.withColumn("num_cells", F.col("cell_count")).join(exposed_area(rows, brick_internal_pairs(rows, n, dims, "gid"), spacing, "gid"), "gid")


def stitched_catalog(parts: DataFrame, roots: DataFrame, edges: DataFrame, spacing: tuple[float, float, float], min_cells: int = 1) -> DataFrame:
    """Merge local components by root: sums, weighted centroids, pooled speed moments, boxes, and the area less
    two faces for every face pair inside a component. Small structures are only dropped after the merge."""
    face = {"x": spacing[1] * spacing[2], "y": spacing[0] * spacing[2], "z": spacing[0] * spacing[1]}
    cut = edges.join(roots.select(F.col("gid").alias("lo"), "root"), "lo").groupBy("root").agg(F.sum(F.col("cnt") * 2.0 * F.create_map(*(F.lit(v) for x in face.items() for v in x))[F.col("axis")]).alias("cut_"))
    n, mean, sd = _d("cell_count"), F.col("velocity_mean"), F.col("velocity_std")
    sums = [F.sum("cell_count").alias("cell_count"), F.sum("volume").alias("volume"), F.sum("mass").alias("mass"), F.sum("area").alias("area_")]
    cents = [(F.sum(F.col(f"centroid_{k}_{a}") * F.col(w)) / (F.sum(w) + TINY)).alias(f"centroid_{k}_{a}") for k, w in (("vol", "volume"), ("mass", "mass")) for a in "xyz"]
    pooled = [(F.sum(mean * n) / F.sum(n)).alias("velocity_mean"), (F.sum((sd * sd + mean * mean) * n) / F.sum(n)).alias("square_")]
    boxes = [f(f"{a}_{s}").alias(f"{a}_{s}") for a in "ijk" for f, s in ((F.min, "min"), (F.max, "max"))]
    out = parts.join(roots, "gid").groupBy("root").agg(*sums, *cents, *pooled, *boxes).join(cut, "root", "left")
    out = out.withColumn("velocity_std", F.sqrt(F.greatest(F.col("square_") - F.col("velocity_mean") * F.col("velocity_mean"), F.lit(0.0))))
    out = out.withColumn("area", F.col("area_") - F.coalesce("cut_", F.lit(0.0))).drop("area_", "cut_", "square_")
    return out.where(F.col("cell_count") >= min_cells) if min_cells > 1 else out


def majority_mapping(left: DataFrame, right: DataFrame, on: str, a: str, b: str) -> DataFrame:
    """For each ``a``, the ``b`` that shares most rows (ties: the smallest): ``a, b, votes``."""
    votes = left.select(on, a).join(right.select(on, b), on).groupBy(a, b).agg(F.count("*").alias("votes"))
    best = votes.groupBy(a).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(b))).alias("m"))
    return best.select(a, F.col(f"m.{b}").alias(b), (-F.col("m.v")).alias("votes"))


def split_components(mapping: DataFrame, whole: str, part: str, k: int = 5) -> DataFrame:
    """The ``k`` wholes with most distinct parts (more than one), a bounded report."""
    return mapping.groupBy(whole).agg(F.countDistinct(part).alias("parts")).where("parts > 1").orderBy(F.desc("parts"), whole).limit(k)


def subgraph_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``first`` (smallest part), ``parts`` and ``components`` of every structure of ``roots`` (``gid, root``): its parts,
    joined anew by those of ``edges`` (``lo, hi``) that have both ends in it. A structure is whole with one component.

    All structures are contracted together; edges between two structures, or to unknown parts, join nothing.
    """
    end = lambda c: roots.select(F.col("gid").alias(c), F.col("root").alias(f"{c}_root"))
    own = edges.join(end("lo"), "lo").join(end("hi"), "hi").where("lo_root = hi_root").select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    found = connected_components(own, roots.select(F.col("gid").alias("id"))).select(F.col("id").alias("gid"), F.col("root").alias("part_"))
    # one row a component first, so that a structure of most parts is no large set in one task
    each = roots.join(found, "gid").groupBy("root", "part_").agg(F.count("*").alias("n_"), F.min("gid").alias("g_"))
    return each.groupBy("root").agg(F.min("g_").alias("first"), F.sum("n_").alias("parts"), F.count("*").alias("components")).drop("root")


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``gid, degree``: distinct neighbours of each local component; isolated ones have 0."""
    ends = edges.where("lo <> hi").select("lo", "hi").distinct()
    both = ends.select(F.col("lo").alias("gid"), F.col("hi").alias("o")).union(ends.select(F.col("hi").alias("gid"), F.col("lo").alias("o")))
    count = both.groupBy("gid").agg(F.countDistinct("o").alias("degree"))
    return vertices.select("gid").distinct().join(count, "gid", "left").select("gid", F.coalesce("degree", F.lit(0)).alias("degree"))


def catalog_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks (multisets), with their side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


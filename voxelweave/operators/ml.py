"""Feature tables: registry, standardisation, correlation, PCA, factor analysis, clustering, sampling."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.operators.components import connected_components
from voxelweave.operators.density import closest_pairs
from voxelweave.operators.spectra import dispersion3d
from voxelweave.scratch import Scratch

DEFAULT_FEATURES = ("volume", "mass", "area", "cell_count", "velocity_std", "velocity_mean")


def flatten(df: DataFrame, name: str) -> Column:
    """A feature as one number per row: principal axes by their largest, other arrays by their first element."""
    kind = dict(df.dtypes)[name]
    if not kind.startswith("array"):
        return F.col(name).cast("double")
    if name == "principal_axes_lengths":
        return F.array_max(name).cast("double")
    if name == "axis_ratios":
        return F.element_at(name, 1).cast("double")
    return F.when(F.size(name) == 1, F.element_at(name, 1)).otherwise(F.raise_error(F.lit(f"{name} has more than one value a row"))).cast("double")


def _vector(name: str, i: int) -> Callable[[DataFrame], Column]:
    def get(df: DataFrame) -> Column:
        return F.element_at(name, i + 1) if dict(df.dtypes)[name].startswith("array") else F.col(name).cast("double")

    return get


def _speed(df: DataFrame) -> Column:
    if dict(df.dtypes)["velocity_mean"].startswith("array"):
        return F.sqrt(F.aggregate("velocity_mean", F.lit(0.0), lambda a, x: a + x * x))
    return F.abs(F.col("velocity_mean").cast("double"))


#: name -> column of a catalog; what a catalog has under that name itself comes first.
DERIVED: dict[str, Callable[[DataFrame], Column]] = {
    "num_cells": lambda df: F.col("cell_count").cast("double"),
    "velocity_mean_x": _vector("velocity_mean", 0),
    "velocity_mean_y": _vector("velocity_mean", 1),
    "velocity_mean_z": _vector("velocity_mean", 2),
    "vx_mean": _vector("velocity_mean", 0),
    "vy_mean": _vector("velocity_mean", 1),
    "vz_mean": _vector("velocity_mean", 2),
    "speed": _speed,
    "velocity_speed": _speed,
    "velocity_mean_mag": _speed,
    "vx_std": lambda df: F.col("velocity_std"),
    "vy_std": lambda df: F.col("velocity_std"),
    "vz_std": lambda df: F.col("velocity_std"),
    "dispersion_3d": lambda df: dispersion3d() if {"vx_std", "vy_std", "vz_std"} <= set(df.columns) else F.col("velocity_std"),
    "dispersion_3d_massw": lambda df: dispersion3d(True) if {"vx_std_massw", "vy_std_massw", "vz_std_massw"} <= set(df.columns) else F.col("velocity_std"),
    "effective_radius": lambda df: F.cbrt("volume"),
    "normalised_area": lambda df: F.col("area") / F.pow("volume", F.lit(8.0 / 9.0)),
    "mean_density": lambda df: F.col("mass") / F.col("volume"),
    "length_i": lambda df: (F.col("i_max") - F.col("i_min")).cast("double"),
    "length_j": lambda df: (F.col("j_max") - F.col("j_min")).cast("double"),
    "length_k": lambda df: (F.col("k_max") - F.col("k_min")).cast("double"),
}


def register_feature(name: str, column: Callable[[DataFrame], Column]) -> None:
    """Add (or replace) a derived feature: a function from a catalog to a column."""
    DERIVED[name] = column


def load_features(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """Features of several catalogs (Parquet) in one table, with ``file``; a KeyError names all that are missing anywhere."""
    if not names:
        raise ValueError("no features asked for")
    tables = [spark.read.parquet(p) for p in paths]
    missing = sorted({n for t in tables for n in names if n not in t.columns and n not in DERIVED})
    if missing:
        raise KeyError(f"missing features: {', '.join(missing)}")
    return reduce(DataFrame.unionByName, [features(t.withColumn("file", F.lit(p)), names, ("file",)) for t, p in zip(tables, paths, strict=True)])


def available_features(df: DataFrame) -> list[str]:
    return sorted({*df.columns, *DERIVED})


def features(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Select features by name; all missing ones are named in one KeyError."""
    missing = sorted(n for n in names if n not in df.columns and n not in DERIVED)
    if missing:
        raise KeyError(f"missing features: {', '.join(missing)}")
    return df.select(*keep, *((flatten(df, n) if n in df.columns else DERIVED[n](df)).cast("double").alias(n) for n in names))


def zscore(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Standardise by population deviation (0 where it is 0); the statistics are one broadcast row."""
    stats = df.agg(*(f(n).alias(f"{n}__{s}") for n in names for s, f in (("m", F.avg), ("s", F.stddev_pop))))
    both = df.crossJoin(F.broadcast(stats))
    return both.select(*keep, *(F.when(F.col(f"{n}__s") > 0, (F.col(n) - F.col(f"{n}__m")) / F.col(f"{n}__s")).otherwise(0.0).alias(n) for n in names))


def pearson(df: DataFrame, names: list[str]) -> DataFrame:
    """``a, b, r`` of every ordered pair, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (p, q) in enumerate(pairs) for a, b in sorted({(p, q), (q, p)})]
    return row.select(F.inline(F.array(*cells)))


def covariance(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population covariance and row count: one aggregation, a p by p result."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(F.count("*"), *(F.avg(n) for n in names), *(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()
    mean, cov = np.array([x or 0.0 for x in row[1 : 1 + len(names)]]), np.zeros((len(names),) * 2)
    for (i, j), v in zip(pairs, row[1 + len(names) :], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return mean, cov, int(row[0])


def pca(df: DataFrame, names: list[str], k: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores ``pc1..``, components (rows) and explained ratios of standardised features; ``k`` is clamped.

    Signs are fixed: the largest loading of each component is positive.
    """
    z = zscore(df, names, keep)
    _, cov, n = covariance(z, names)
    value, vector = np.linalg.eigh(cov)
    k = max(1, min(k, len(names), max(n, 1)))
    value, parts = value[::-1], vector[:, ::-1].T[:k]
    parts = parts * np.sign(parts[np.arange(k), np.abs(parts).argmax(1)])[:, None]
    cols = [sum((F.col(n_) * float(w) for n_, w in zip(names, p, strict=True)), F.lit(0.0)).alias(f"pc{i + 1}") for i, p in enumerate(parts)]
    return z.select(*keep, *cols), parts, value[:k] / max(value.sum(), 1e-300)


def factor_analysis(df: DataFrame, names: list[str], k: int, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (features by factors) and noise variances, by expectation maximisation on the p by p covariance."""
    _, cov, _ = covariance(zscore(df, names), names)
    k = min(k, len(names))
    value, vector = np.linalg.eigh(cov)
    load, noise = vector[:, ::-1][:, :k] * np.sqrt(np.maximum(value[::-1][:k], 1e-6)) * 0.7, np.maximum(np.diag(cov) * 0.5, 1e-6)
    for _ in range(steps):
        inv = np.linalg.inv(load @ load.T + np.diag(noise))
        beta = load.T @ inv
        second = np.eye(k) - beta @ load + beta @ cov @ beta.T
        load = cov @ beta.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(cov - load @ beta @ cov), 1e-9)
    return load, noise


#: Rows of a partition that ``kmeans`` fits on. What it caches is several times as large as the rows in a file, and a task reads
#: its partition's share of all of it.
FIT_ROWS = 250_000


def kmeans(df: DataFrame, names: list[str], k: int, seed: int = 42, keep: tuple[str, ...] = (), with_features: bool = False) -> DataFrame:
    """Cluster standardised features: ``keep, cluster``, and the standardised features if asked for.

    The fit works on partitions of at most some ``FIT_ROWS`` rows, whatever the files' sizes. Features are dense, so rows are
    taken in blocks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    z, vector = zscore(df, names, keep), VectorAssembler(inputCols=names, outputCol="f_")
    dealt = z.select(*names).repartition(math.ceil(df.count() / FIT_ROWS) or 1)
    model = KMeans(k=k, seed=seed, featuresCol="f_", predictionCol="cluster", solver="block").fit(vector.transform(dealt))
    return model.transform(vector.transform(z)).select(*keep, "cluster", *(names if with_features else ()))


def dbscan(df: DataFrame, key: str, names: list[str], eps: float, min_points: int) -> DataFrame:
    """Density clusters: ``key, cluster`` (-1: noise; a border point joins the smallest reachable cluster).

    Points lie in boxes of side eps / sqrt(d), so two points of one box are always neighbours: a box of ``min_points``
    is core as a whole, its points are one vertex, and no pair inside a box is looked at. Only points of boxes
    that are not full are counted against the boxes around; two full boxes meet by their closest pair.
    Coincident points are one weighted point, so a value that many rows share costs one row.
    """
    d = len(names)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    reach = math.ceil(eps / side)
    box = [f"b{i}" for i in range(d)]
    same = df.groupBy(*names).agg(F.min(key).alias("id_"), F.count("*").alias("w_"))
    pts = same.select("*", *(F.floor(F.col(n) / side).cast("bigint").alias(b) for n, b in zip(names, box, strict=True)))
    full = pts.groupBy(*box).agg(F.sum("w_").alias("in_box"), F.min("id_").alias("box_id"))
    scratch = Scratch(df.sparkSession, "dbscan")
    pts = scratch.keep(pts.join(full, box), "points")

    def spread(p: DataFrame) -> DataFrame:
        for b in box:
            p = p.withColumn(b, F.explode(F.sequence(F.col(b) - reach, F.col(b) + reach)))
        return p

    d2 = sum(((F.col(n) - F.col(f"o_{n}")) * (F.col(n) - F.col(f"o_{n}")) for n in names), F.lit(0.0))
    other = pts.select(*(F.col(n).alias(f"o_{n}") for n in names), F.col("id_").alias("o_id"), F.col("w_").alias("o_w"), F.col("in_box").alias("o_in"), F.col("box_id").alias("o_box"), *box)
    open_pts = pts.where(F.col("in_box") < min_points)
    counted = spread(open_pts.select(*names, "id_", "box_id", *box)).join(other, box).where((d2 <= eps * eps) | (F.col("box_id") == F.col("o_box")))
    core = counted.groupBy("id_").agg(F.sum("o_w").alias("m")).where(F.col("m") >= min_points).select("id_")
    # a core point's vertex is its own id, or its box's
    flagged = pts.join(core.withColumn("core_", F.lit(True)), "id_", "left").withColumn("core_", F.coalesce("core_", F.lit(False)) | (F.col("in_box") >= min_points))
    flagged = flagged.withColumn("vertex", F.when(F.col("in_box") >= min_points, F.col("box_id")).otherwise(F.col("id_")))
    flagged = scratch.keep(flagged, "flagged")
    cores = flagged.where("core_")
    # of two vertices in reach one pair of points is looked for, by halving boxes; not all pairs of two crowded boxes
    links = closest_pairs(cores.select(F.col("id_").alias("id"), *names, F.lit(0.0).alias("core"), F.col("vertex").alias("comp")), names, side, eps, scratch, "links")
    roots = connected_components(links.select(F.col("ca").alias("src"), F.col("cb").alias("dst")), cores.select(F.col("vertex").alias("id")), scratch)
    near = cores.select(*(F.col(n).alias(f"o_{n}") for n in names), F.col("vertex").alias("o_vertex"), F.col("box_id").alias("o_box"), *box)
    # a box has fewer than min_points border points
    met = spread(flagged.where("NOT core_").select(*names, "id_", "box_id", *box)).join(near, box).where((d2 <= eps * eps) | (F.col("box_id") == F.col("o_box")))
    met = met.select("id_", "o_vertex").distinct()
    of_core = cores.join(roots, F.col("vertex") == F.col("id")).select("id_", F.col("root").alias("cluster"))
    of_border = met.join(roots, F.col("o_vertex") == F.col("id")).groupBy("id_").agg(F.min("root").alias("cluster"))
    named = same.join(of_core.union(of_border), "id_", "left").select(*names, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return df.select(key, *names).join(named, names).select(key, "cluster")


def weighted_sample(df: DataFrame, n: int, weight: str = "uniform", seed: int = 42, key: str = "gid") -> DataFrame:
    """``n`` rows without replacement, by exponential keys; weights: uniform, sqrt_volume, sqrt_mass,
    log_volume, log_mass. If all weights are 0, uniform.

    The random numbers are digests of ``key`` and ``seed``, so the sample does not depend on partitions or retries.
    """
    w = {
        "uniform": F.lit(1.0), "sqrt_volume": F.sqrt("volume"), "sqrt_mass": F.sqrt("mass"), "log_volume": F.log1p("volume"), "log_mass": F.log1p("mass"),
    }[weight]
    if weight != "uniform" and not (df.agg(F.sum(w)).first()[0] or 0) > 0:
        w = F.lit(1.0)
    # 52 bits of the digest, as a number inside (0, 1)
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / float(1 << 52)
    return df.withColumn("k_", F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf")))).orderBy("k_", key).limit(n).drop("k_")


def embedding(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A plane of the features (``e1, e2``): their two leading principal components."""
    out, _, _ = pca(df, names, 2, keep)
    return out.withColumnsRenamed({"pc1": "e1", "pc2": "e2"})

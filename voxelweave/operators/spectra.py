"""Catalog analytics: histograms, size spectra, cumulative curves, medians, power-law slopes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelweave.scratch import Scratch


def positive(col: str) -> Column:
    """Finite and above zero."""
    x = F.col(col).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))


def sizes(df: DataFrame) -> DataFrame:
    """The size column, under whichever of its names is there."""
    names = [c for c in ("cell_count", "num_cells") if c in df.columns]
    if not names:
        raise KeyError("neither cell_count nor num_cells")
    return df.withColumn("size", F.coalesce(*names).cast("double")).where(positive("size"))


def geometric_edges(lo: float, hi: float, n_bins: int) -> list[float]:
    return [float(x) for x in np.geomspace(lo, hi, n_bins + 1)]


def log_edges(lo: float, hi: float, points: int) -> list[float]:
    """``points`` geometric edges, that is one bin fewer."""
    return [float(x) for x in np.geomspace(lo, hi, points)]


def integer_edges(r_min: float, r_max: float, n_bins: int) -> list[int]:
    """``n_bins`` bins with integer edges, as even in the logarithm as integers allow, from ``r_min`` to ``r_max`` (both
    rounded, 1 at least); where the range holds fewer integers than ``n_bins + 1``, all of them.

    Each edge is the integer nearest to its geometric place, moved up as far as the edge before requires and down as far
    as the edges after do: small edges go up by ones, and the geometric steps begin where they exceed one.
    """
    low = max(1, round(r_min))
    high = max(low + 1, round(r_max))
    n = min(n_bins, high - low)
    place = np.rint(np.geomspace(low, high, n + 1)).astype(np.int64)
    step = np.arange(n + 1)
    edges = np.maximum.accumulate(place - step) + step
    return [int(x) for x in np.minimum(edges, high - step[::-1])]


def bin_index(x: Column, edges: list[float], closed: bool = True) -> Column:
    """0-based bin of ``x``; null outside; the last bin is closed (or not: ``closed=False``).

    A binary decision tree over the edges, so a row takes a logarithmic number of comparisons.
    """
    n = len(edges) - 1

    def tree(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(x < F.lit(float(edges[mid])), tree(a, mid)).otherwise(tree(mid, b))

    top = x <= F.lit(float(edges[-1])) if closed else x < F.lit(float(edges[-1]))
    return F.when((x >= F.lit(float(edges[0]))) & top, tree(0, n))


def edge_table(df: DataFrame, edges: list[float]) -> DataFrame:
    """``bin, lo, hi, mid`` (geometric mean), a bounded table."""
    rows = [(i, float(a), float(b), math.sqrt(a * b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return df.sparkSession.createDataFrame(rows, "bin int, lo double, hi double, mid double")


def histogram(df: DataFrame, col: str, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per bin; empty bins are there with 0 when there is no ``by``."""
    counts = df.withColumn("bin", bin_index(F.col(col).cast("double"), edges)).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    if by:
        return counts.join(F.broadcast(edge_table(df, edges)), "bin").select(*by, "bin", "lo", "hi", "mid", "n")
    return edge_table(df, edges).join(counts, "bin", "left").select("bin", "lo", "hi", "mid", F.coalesce("n", F.lit(0)).alias("n"))


def size_spectrum(df: DataFrame, col: str, edges: list[float], by: tuple[str, ...] = (), per_width: bool = True) -> DataFrame:
    """``V dN/dlnV`` per bin: mid * n / ln(hi/lo); the fitters' variant omits the width."""
    h = histogram(df, col, edges, by)
    width = F.log(F.col("hi") / F.col("lo")) if per_width else F.lit(1.0)
    return h.withColumn("spectrum", F.col("mid") * F.col("n") / width)


def compare_spectra(a: DataFrame, b: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Two catalogs on shared bins and their ratio (null where the first is empty)."""
    one = size_spectrum(a, col, edges).select("bin", "mid", F.col("n").alias("n_a"), F.col("spectrum").alias("spectrum_a"))
    two = size_spectrum(b, col, edges).select("bin", F.col("n").alias("n_b"), F.col("spectrum").alias("spectrum_b"))
    totals = one.agg(F.sum("n_a").alias("total_a")).crossJoin(two.agg(F.sum("n_b").alias("total_b")))  # one row
    one = one.crossJoin(F.broadcast(totals))
    return one.join(two, "bin").withColumn("ratio", F.when(F.col("spectrum_a") > 0, F.col("spectrum_b") / F.col("spectrum_a")))


def hist2d(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """Non-empty cells of a joint histogram: ``xbin, ybin, n``."""
    rows = df.where(positive(x) & positive(y)).select(bin_index(F.col(x).cast("double"), x_edges).alias("xbin"), bin_index(F.col(y).cast("double"), y_edges).alias("ybin"))
    return rows.where("xbin IS NOT NULL AND ybin IS NOT NULL").groupBy("xbin", "ybin").agg(F.count("*").alias("n"))


def pair_histograms(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Joint histograms of every pair of the named columns, in one scan and one aggregation: ``x, y, xbin, ybin, n``.

    As ``hist2d`` for each pair: both values positive and finite, and inside their edges. Bins are found once a column.
    """
    names = list(edges)
    bins = df.select(*(F.when(positive(n), bin_index(F.col(n).cast("double"), edges[n])).alias(f"b{i}") for i, n in enumerate(names)))
    pairs = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"b{i}").alias("xbin"), F.col(f"b{j}").alias("ybin")) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, xbin int, ybin int, n bigint")
    return bins.select(F.inline(F.array(*pairs))).where("xbin IS NOT NULL AND ybin IS NOT NULL").groupBy("x", "y", "xbin", "ybin").agg(F.count("*").alias("n"))


def dispersion3d(massw: bool = False) -> Column:
    """Three-dimensional velocity dispersion from the components' deviations."""
    s = "_massw" if massw else ""
    return F.sqrt(sum((F.col(f"v{a}_std{s}") * F.col(f"v{a}_std{s}") for a in "xyz"), F.lit(0.0)))


def normalised_area() -> Column:
    return F.col("area") / F.pow(F.col("volume"), F.lit(8.0 / 9.0))


def median_curve(df: DataFrame, x: str, y: str, edges: list[float], least: int = 5) -> DataFrame:
    """Per half-open bin with at least ``least`` rows: geometric-mean x, median y, count."""
    rows = df.where(positive(x) & positive(y)).withColumn("bin", bin_index(F.col(x).cast("double"), edges, closed=False)).where("bin IS NOT NULL")
    means = rows.groupBy("bin").agg(F.exp(F.avg(F.log(F.col(x).cast("double")))).alias("x_geo")).withColumnRenamed("bin", "b_")
    middle = exact_median(rows, ["bin"], y).where(F.col("n") >= least)
    return middle.join(means, F.col("bin") == F.col("b_")).select("bin", "x_geo", F.col("median").alias("y_median"), "n")


def powerlaw_fit(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Least squares in log-log: ``slope, intercept, n``."""
    lx, ly = F.log10(F.col(x).cast("double")), F.log10(F.col(y).cast("double"))
    return df.where(positive(x) & positive(y)).groupBy(*by).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.count("*").alias("n"))


def powerlaw_segment_fit(curve: DataFrame, x: str, y: str, lo: float = 0.55, hi: float = 0.80) -> DataFrame:
    """The same over an index window of a curve's valid points, by x (a curve has one row a threshold, so it is small)."""
    w = W.orderBy(x)
    rows = curve.where(positive(x) & positive(y)).withColumns({"i_": F.row_number().over(w) - 1, "n_": F.count("*").over(W.partitionBy())})
    return powerlaw_fit(rows.where((F.col("i_") >= F.floor(F.col("n_") * lo)) & (F.col("i_") < F.ceil(F.col("n_") * hi))), x, y)


def cumulative_product(df: DataFrame, col: str, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``t, count, product``: how many values are >= t, times t, from one histogram and its suffix sums."""
    t = sorted(thresholds)
    place = bin_index(F.col(col).cast("double"), [*t, float("inf")])
    counts = df.where(positive(col)).withColumn("bin", place).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "bin int, t double")
    frame = grid.crossJoin(counts.select(*by).distinct()) if by else grid
    full = F.broadcast(frame) if not by else frame
    joined = full.join(counts, [*by, "bin"], "left")
    suffix = W.partitionBy(*by).orderBy(F.desc("bin"))
    return joined.select(*by, "t", F.sum(F.coalesce("n", F.lit(0))).over(suffix).alias("count")).withColumn("product", F.col("count") * F.col("t"))


def envelope(products: DataFrame) -> DataFrame:
    """Median, least and greatest product of several catalogs at each threshold."""
    return products.groupBy("t").agg(F.median("product").alias("p_median"), F.min("product").alias("p_min"), F.max("product").alias("p_max"))


def reverse_rank(df: DataFrame, col: str, by: str, tie: str) -> DataFrame:
    """``N(>= V)`` by rank (ties have ranks of their own), ``V * N`` and the normalised curve, per ``by``.

    Rows are range-parted by (``by``, value, ``tie``), written once, numbered inside their part, and shifted by the
    counts of the parts before; so neither a catalog nor a value that holds most rows is one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(by).asc(), F.col(col).desc(), F.col(tie).asc()]
    rows = Scratch(spark, "ranks").keep(df.select(by, tie, col).repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), "rows")
    counts = rows.groupBy(by, "part_").agg(F.count("*").alias("c_"))
    up = W.partitionBy(by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(F.col(by).alias("by_"), F.col("part_").alias("p_"), F.coalesce(F.sum("c_").over(up), F.lit(0)).alias("s_"), F.sum("c_").over(W.partitionBy(by)).alias("all_"))
    local = F.row_number().over(W.partitionBy(by, "part_").orderBy(*order))
    # one row a part and a catalog in it: as many as parts and catalogs together
    out = rows.withColumn("l_", local).join(shift, F.col(by).eqNullSafe(F.col("by_")) & (F.col("part_") == F.col("p_")))
    n = F.col("l_") + F.col("s_")
    return out.select(by, tie, col, n.alias("n_ge"), (F.col(col) * n).alias("product"), (n / F.col("all_")).alias("cdf"))


def exact_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, median, n`` without a task that holds all values of a group: equal values are counted first, the counts are
    range-parted and summed in order, and the one or two values at the middle are picked."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("c_"))
    rows = Scratch(spark, "median").keep(counts.repartitionByRange(parts, *by, "v_").withColumn("part_", F.spark_partition_id()), "rows")
    sums = rows.groupBy(*by, "part_").agg(F.sum("c_").alias("k_"))
    before = W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    shift = sums.select(*(F.col(b).alias(f"by_{b}") for b in by), F.col("part_").alias("p_"), F.coalesce(F.sum("k_").over(before), F.lit(0)).alias("s_"), F.sum("k_").over(W.partitionBy(*by)).alias("n"))
    at = F.sum("c_").over(W.partitionBy(*by, "part_").orderBy("v_"))
    same = F.col("part_") == F.col("p_")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"by_{b}"))
    placed = rows.withColumn("up_", at).join(shift, same).withColumn("hi_", F.col("up_") + F.col("s_")).withColumn("lo_", F.col("hi_") - F.col("c_"))
    left, right = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    inside = lambda k: (F.col("lo_") <= k) & (k < F.col("hi_"))
    middle = F.sum(F.when(inside(left), F.col("v_"))) + F.sum(F.when(inside(right), F.col("v_")))
    return placed.groupBy(*by).agg((middle / 2).alias("median"), F.max("n").alias("n"))

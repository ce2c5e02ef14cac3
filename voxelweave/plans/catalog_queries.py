"""Catalog queries: every ``lineitem`` row is a structure, every ship year a snapshot.

volume = cell_count = quantity (integers 1..50), mass = extended price, area = 1 + tax, velocity_std = discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.operators import ml, models
from voxelweave.operators import spectra as S
from voxelweave.scratch import Scratch
from voxelweave.sources import readers

EDGES = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 51.0]
MASS_EDGES = [100.0, 1000.0, 5000.0, 10000.0, 50000.0, 200000.0]
STD_EDGES = [0.005, 0.015, 0.035, 0.065, 0.11]
AREA_EDGES = [0.01, 0.05, 0.1, 0.3, 0.6, 1.2]
T = [1.0, 5.0, 10.0, 20.0, 30.0, 40.0, 45.0, 50.0]
CUTS = [0.0, 1.0, 8.0, 20.0]
ALPHAS = [-1.5, -0.5, 0.5, 1.5]
#: log10 V0, gamma, beta, log10 Vcut: slopes free, slopes fixed, steeper.
DPL = [(1.0, -0.5, 0.7, 0.3), (1.2, 0.0, -4.0 / 9, 0.5), (0.8, 0.3, 1.5, -1.0)]
NAMES = ["volume", "mass", "area", "velocity_std"]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("l_shipdate")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gid"), year.alias("step"), F.col("l_quantity").cast("bigint").alias("cell_count"), F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("mass"), (F.lit(1.0) + F.col("l_tax")).alias("area"), F.col("l_discount").alias("velocity_std"), F.col("l_tax").alias("velocity_mean"),
        F.col("l_suppkey").alias("supp"),
    )


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def size_histogram(spark, d):
    return S.histogram(S.sizes(catalog(spark, d)), "size", EDGES).select("bin", "lo", "hi", "n")


def size_spectrum(spark, d):
    return _r(S.size_spectrum(S.sizes(catalog(spark, d)).where("size > 8"), "size", EDGES)).select("bin", "n", "spectrum")


def volume_spectra_by_step(spark, d):
    return _r(S.size_spectrum(catalog(spark, d).where("cell_count > 8"), "volume", EDGES, ("step",))).select("step", "bin", "n", "spectrum")


def spectrum_compare_ratio(spark, d):
    c = catalog(spark, d)
    return _r(S.compare_spectra(c.where("step <= 1994"), c.where("step > 1994"), "volume", EDGES)).drop("mid")


def hist2d_size_vdisp(spark, d):
    return S.hist2d(catalog(spark, d), "volume", "velocity_std", EDGES, STD_EDGES)


def hist2d_area89(spark, d):
    return S.hist2d(catalog(spark, d).withColumn("a89", S.normalised_area()), "volume", "a89", EDGES, AREA_EDGES)


def cumulative_product(spark, d):
    return S.cumulative_product(catalog(spark, d), "volume", T)


def cumulative_count(spark, d):
    return S.cumulative_product(catalog(spark, d), "volume", T, ("step",)).select("step", "t", "count")


def cumulative_envelope(spark, d):
    return S.envelope(S.cumulative_product(catalog(spark, d), "volume", T, ("step",)))


def reverse_rank_cdf(spark, d):
    return _r(S.reverse_rank(catalog(spark, d), "mass", "step", "gid"))


def median_curve(spark, d):
    return _r(S.median_curve(catalog(spark, d), "mass", "volume", MASS_EDGES))


def powerlaw_fit(spark, d):
    return _r(S.powerlaw_fit(catalog(spark, d), "volume", "mass", ("step",)))


def powerlaw_segment_fit(spark, d):
    return _r(S.powerlaw_segment_fit(S.cumulative_product(catalog(spark, d), "volume", [float(t) for t in range(1, 51)]), "t", "product"))


def pearson_matrix(spark, d):
    return _r(ml.pearson(catalog(spark, d), NAMES))


def zscore_features(spark, d):
    return _r(ml.zscore(ml.features(catalog(spark, d), NAMES, ("gid",)), NAMES, ("gid",)), 5)


def feature_flatten(spark, d):
    c = catalog(spark, d).withColumns({"principal_axes_lengths": F.array("volume", "area", "velocity_std"), "axis_ratios": F.array("area", "velocity_std")})
    return _r(ml.features(c, ["principal_axes_lengths", "axis_ratios", "num_cells", "mean_density", "dispersion_3d"], ("gid",)), 9)


def box_units(spark, d):
    """Sizes in cells, by the median cell volume of a catalog, and as shares of a box of 64 cells a side."""
    c = catalog(spark, d).withColumn("cv", F.col("volume") / F.greatest("cell_count", F.lit(1)))
    unit = S.exact_median(c, [], "cv").select(F.col("median").alias("cell_volume"))
    dx = F.pow("cell_volume", F.lit(1.0 / 3))
    return _r(c.crossJoin(F.broadcast(unit)).groupBy("step", "cell_volume").agg(F.sum(F.col("volume") / F.col("cell_volume")).alias("cells"), F.max(dx).alias("dx"), F.sum(F.col("volume") / F.pow(dx * 64, F.lit(3.0))).alias("box_share")))


def exact_median_by_step(spark, d):
    return _r(S.exact_median(catalog(spark, d), ["step"], "mass"))


def _gappy(spark, d):
    """All rows; every third snapshot's structures reach no farther than 31, so that it has no greater bins."""
    return catalog(spark, d).withColumn("volume", F.when(F.col("step") % 3 == 0, F.least("volume", F.lit(31.0))).otherwise(F.col("volume")))


def _spectra(spark, d):
    return S.size_spectrum(_gappy(spark, d), "volume", EDGES, ("step",), per_width=False)


def _snapshots(spark, d):
    return catalog(spark, d).select("step").distinct().count()


def snapshot_summary(spark, d):
    return catalog(spark, d).groupBy("step").agg(F.count("*").alias("n_clumps"), F.sum("volume").alias("total_vol"))


def anchor_normalise(spark, d):
    target = models.anchor_target(catalog(spark, d).agg(F.max("volume")).first()[0])
    return _r(models.anchor_normalise(_spectra(spark, d), "step", target, _snapshots(spark, d)))


def snapshot_bin_mean_std(spark, d):
    """Mean and deviation of the normalised spectra; a snapshot without a bin counts as zero there."""
    target = models.anchor_target(catalog(spark, d).agg(F.max("volume")).first()[0])
    return _r(models.bin_mean_std(models.anchor_normalise(_spectra(spark, d), "step", target, _snapshots(spark, d)), _snapshots(spark, d), "normalised"))


def bins_all_any(spark, d):
    return models.bins_all_any(_spectra(spark, d), "step", _snapshots(spark, d))


def powerlaw_nll_grid(spark, d):
    stats = models.powerlaw_statistics(catalog(spark, d), "volume", CUTS)
    grid = spark.createDataFrame([(a,) for a in ALPHAS], "alpha double")
    return stats.crossJoin(F.broadcast(grid)).select("cut", "alpha", "n", F.round(models.powerlaw_nll(F.col("alpha")), 3).alias("nll"))


def aic_bic_grid(spark, d):
    g = powerlaw_nll_grid(spark, d).withColumns({"aic": 2 + 2 * F.col("nll"), "bic": F.log("n") + 2 * F.col("nll")})
    best = g.groupBy("cut").agg(F.min("aic").alias("best"))
    return _r(g.join(best, "cut").select("cut", "alpha", "aic", "bic", (F.col("aic") - F.col("best")).alias("delta_aic")), 3)


def dpl_nll_table(spark, d):
    """Likelihood of the broken power law with small-V cut-off at given parameters."""
    return models.dpl_nll_table(catalog(spark, d), "volume", DPL).select("log_v0", "gamma", "beta", "log_cut", "n", F.round("nll", 2).alias("nll"))


def aic_bic_table(spark, d):
    """Information criteria of slope 0, slope 4/9 and broken power laws at given parameters."""
    stats = models.powerlaw_statistics(catalog(spark, d), "volume", [0.0])
    lines = [stats.select(F.lit(name).alias("model"), "n", F.lit(0).alias("k"), models.powerlaw_nll(F.lit(a - 1.0)).alias("nll")) for name, a in (("zipf", 0.0), ("power_law_49", -models.BETA_FIXED))]
    broken = models.dpl_nll_table(catalog(spark, d), "volume", DPL[:2])
    name = F.when(F.col("gamma") == DPL[0][1], "double_power_law").otherwise("double_power_law_fixed")
    every = lines[0].union(lines[1]).union(broken.select(name, "n", F.when(F.col("gamma") == DPL[0][1], 4).otherwise(2), "nll"))
    t = every.withColumns({"aic": 2 * F.col("k") + 2 * F.col("nll"), "bic": F.col("k") * F.log("n") + 2 * F.col("nll")})
    best = t.agg(F.min("aic").alias("best"))
    return t.crossJoin(F.broadcast(best)).select("model", "k", "n", *(F.round(c, 2).alias(c) for c in ("nll", "aic", "bic")), F.round(F.col("aic") - F.col("best"), 2).alias("delta_aic"))


def vmin_sweep(spark, d):
    return models.vmin_sweep(catalog(spark, d), "volume", CUTS).select("cut", "n", F.round("alpha", 3).alias("alpha"), *(F.round(c, 2).alias(c) for c in ("nll", "nll_zipf", "aic", "bic", "delta_aic")))


def model_curves(spark, d):
    """log10 of the model curves at every size that occurs."""
    v = catalog(spark, d).select("volume").distinct()
    return v.select("volume", *(F.round(models.log_floor(c), 6).alias(n) for n, c in _curves(F.col("volume")).items()))


def curve_rss_table(spark, d):
    """Residuals of given curves against the mean spectrum, over three ranges of sizes."""
    points = S.size_spectrum(catalog(spark, d), "volume", EDGES, per_width=False)
    sizes = {"power_law": 2, "dpl": 6, "dpl_steep": 6, "beuermann": 7}
    curves = {n: (c, sizes[n]) for n, c in _curves(F.col("mid")).items() if n in sizes}
    return models.rss_table(points, "mid", "spectrum", curves, [(0.0, 1e9), (2.0, 1e9), (5.0, 1e9)]).select("model", "lo", "n", F.round("rss", 5).alias("rss"), F.round("aic", 4).alias("aic"))


def _curves(x):
    return {
        "power_law": models.power_law(x, 3.0, 0.5), "zipf": models.power_law(x, 3.0, 0.0), "floor": models.power_law(x, 1e-40, 0.1), "dpl": models.broken_power_law(x, 1000.0, 1.0, -0.5, 0.7, 0.3, 2.0),
        "dpl_steep": models.broken_power_law(x, 10.0, 0.5, 0.0, -4.0 / 9, 1.0, 0.5), "beuermann": models.broken_power_law(x, 20000.0, 1.2, -0.9, 0.4, 0.2, 1.5, 3.0),
    }


def run_name_parse(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    name = F.concat(F.lit("res"), F.col("o_custkey").cast("string"), F.lit("_x_step"), F.lpad(F.month("o_orderdate").cast("string"), 5, "0"), F.lit("_conn6_T0p0"), (F.col("o_orderkey") % 9).cast("string"))
    return o.withColumn("name", F.when(F.col("o_orderkey") % 7 == 0, F.lit("other")).otherwise(name)).select("o_orderkey", *readers.run_fields(F.col("name")))


def step_over_30(spark, d):
    """Snapshots by the number in a directory's name, only those after step 30."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("dir", F.concat(F.lit("n640_sweep/step"), F.lpad((F.col("event_id") % 60).cast("string"), 5, "0")))
    step = F.regexp_extract("dir", r"step(\d+)", 1).cast("int")
    return e.select(step.alias("step"), F.regexp_extract("dir", r"n(\d+)_sweep", 1).cast("int").alias("res")).where("step > 30").groupBy("step", "res").agg(F.count("*").alias("n"))


def label_sanitize(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", readers.sanitised(F.concat(F.lit(" ⟨v⟩-"), "p_name", F.lit(" / "), "p_type", F.lit(" σ!"))).alias("label"))


def pair_histograms(spark, d):
    """Joint histograms of every pair of features with at least 50 positive values on either side."""
    c, edges = catalog(spark, d), {"volume": EDGES, "mass": MASS_EDGES, "area": [1.0, 1.02, 1.05, 1.09], "velocity_std": STD_EDGES}
    enough = c.agg(*(F.count_if(S.positive(n)).alias(n) for n in NAMES)).first()
    shown = {n: edges[n] for n in NAMES if enough[n] >= 50}
    return S.pair_histograms(c, shown).withColumnsRenamed({"x": "a", "y": "b"})


def step_or_ordinal(spark, d):
    """The step in a directory's name, else its place in the order of names (few directories)."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("run"), (F.col("event_id") % 7).cast("string"))).otherwise(F.concat(F.lit("step"), (F.col("event_id") % 5).cast("string"))).alias("dir")).distinct()
    found = F.nullif(F.regexp_extract("dir", r"step(\d+)", 1), F.lit("")).cast("int")
    return e.select("dir", F.coalesce(found, F.row_number().over(W.orderBy("dir")) - 1).alias("step"))


def integer_bin_spectrum(spark, d):
    return _r(S.size_spectrum(catalog(spark, d), "volume", [float(x) for x in S.integer_edges(1, 51, 8)])).select("lo", "hi", "n", "spectrum")


def effective_radius(spark, d):
    """Sizes in cells, with the spacing from the catalog, else the resolution, else the finest run's."""
    c = catalog(spark, d).withColumns({"spacing": F.when(F.col("gid") % 3 == 0, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), "res": F.when(F.col("gid") % 3 == 1, F.lit(4))})
    dx = readers.spacing_chain(F.col("spacing"), F.col("res"))
    return _r(c.select("gid", (F.cbrt("volume") / dx).alias("r_eff"), (F.col("volume") / F.pow(dx, F.lit(3.0))).alias("v_cells")), 3)


def _table(spark, d):
    return ml.features(catalog(spark, d), NAMES, ("gid",))


def pca_scores(spark, d):
    """A full set of scores is a rotation: its squared length is that of the standardised features."""
    scores = ml.pca(_table(spark, d), NAMES, 8, ("gid",))[0]
    return scores.select("gid", F.round(sum((F.col(f"pc{i}") * F.col(f"pc{i}") for i in range(1, len(NAMES) + 1)), F.lit(0.0)), 5).alias("square"))


def pca_explained(spark, d):
    """Correlations rebuilt from components and explained ratios, for every ordered pair of features."""
    _, parts, ratio = ml.pca(_table(spark, d), NAMES, 8)
    full = (parts.T * ratio * len(NAMES)) @ parts
    return _r(spark.createDataFrame([(a, b, float(full[i, j])) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)], "a string, b string, r double"))


def fa_loadings(spark, d):
    """Communality and noise of each feature, which make up its variance."""
    load, noise = ml.factor_analysis(_table(spark, d), NAMES, 2)
    return spark.createDataFrame([(n, round(float((row**2).sum() + v), 4), bool(v > 0)) for n, row, v in zip(NAMES, load, noise, strict=True)], "feature string, variance double, noisy boolean")


def embedding_plane(spark, d):
    """The plane's axes have no covariance, and the variances of the two leading components."""
    e = ml.embedding(_table(spark, d), NAMES, ("gid",)).agg(F.count("*").alias("n"), F.covar_pop("e1", "e2").alias("c"), F.var_pop("e1").alias("v1"), F.var_pop("e2").alias("v2"))
    return e.select("n", (F.abs("c") < 1e-6).alias("uncorrelated"), ((F.col("v1") >= F.col("v2")) & (F.col("v1") + F.col("v2") <= len(NAMES))).alias("ordered"))


def kmeans_clusters(spark, d):
    """Number of clusters, and whether they explain variance and (but for ties of the last step) rows are at the nearest centre."""
    z = ml.kmeans(_table(spark, d), NAMES, 4, keep=("gid",), with_features=True)
    z = Scratch(spark, "kmeans").keep(z, "assigned")
    # a few centres, one flat row: each structure is compared where it is, none is shuffled
    centres = z.groupBy("cluster").agg(*(F.avg(n).alias(n) for n in NAMES)).agg(F.array_sort(F.collect_list(F.struct("cluster", *NAMES))).alias("c"))
    flat = centres.select(*(F.get("c", F.lit(i))[n].alias(f"c{i}_{n}") for i in range(4) for n in ("cluster", *NAMES)))
    d2 = lambda i: sum(((F.col(n) - F.col(f"c{i}_{n}")) * (F.col(n) - F.col(f"c{i}_{n}")) for n in NAMES), F.lit(0.0))
    met = z.crossJoin(F.broadcast(flat)).select("cluster", *(d2(i).alias(f"d{i}") for i in range(4)), *(f"c{i}_cluster" for i in range(4))).withColumn("least", F.least("d0", "d1", "d2", "d3"))
    met = met.select("cluster", *(F.coalesce(*(F.when(when(i), value(i)) for i in range(4))).alias(name) for name, when, value in (
        ("nearest", lambda i: F.col(f"d{i}") == F.col("least"), lambda i: F.col(f"c{i}_cluster")),
        ("own", lambda i: F.col(f"c{i}_cluster") == F.col("cluster"), lambda i: F.col(f"d{i}")),
    )))
    return met.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"), (F.avg((F.col("nearest") == F.col("cluster")).cast("int")) >= 0.98).alias("nearest"), (F.avg("own") < 0.8 * len(NAMES)).alias("explained"))


def dbscan_clusters(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_nationkey") / 5).alias("y"))
    return ml.dbscan(c, "key", ["x", "y"], 0.25, 5).select("key", (F.col("cluster") >= 0).alias("clustered"))


def dbscan_sizes(spark, d):
    """Rows of each cluster, without its name."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    core = ml.dbscan(c, "key", ["x", "y"], 0.2, 3).where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"))
    return core.groupBy("n").agg(F.count("*").alias("clusters"))


def weighted_sample(spark, d):
    return ml.weighted_sample(catalog(spark, d).select("gid", "volume", "mass"), 500, "sqrt_volume")


#: Edges of the fitted spectrum, and the fits that are straight lines in log10.
FIT_EDGES = S.geometric_edges(900.0, 110000.0, 24)
LINES = ("zipf", "power_law_49", "power_law")


def nlls_model_fits(spark, d):
    """The seven fitted curves: parameters, points, residuals and information of the straight lines (whose optimum has a
    closed form), and whether the curves that contain a line are no worse than it."""
    fits = models.fit_curves(S.size_spectrum(catalog(spark, d), "mass", FIT_EDGES), "mid", "spectrum")
    lines = fits.where(F.col("model").isin(list(LINES))).agg(F.max(F.when(F.col("model") == "zipf", F.col("rss"))).alias("flat"))
    line = F.col("model").isin(list(LINES))
    held = F.when(F.col("model") == "power_law_49", F.lit(True)).otherwise(F.col("rss") <= F.col("flat") * (1 + 1e-9))
    return fits.crossJoin(F.broadcast(lines)).select("model", "k", "n", F.when(line, F.round("rss", 6)).alias("rss"), F.when(line, F.round("aic", 4)).alias("aic"), held.alias("no_worse"), (F.col("delta_aic") >= 0).alias("ranked"))


def dpl_mle_fit(spark, d):
    """The five likelihood fits: rows, parameters, and whether free models are at least as likely as those they contain."""
    t = models.model_table(catalog(spark, d), "cell_count")
    nll = {r["model"]: r["nll"] for r in t.collect()}
    good = nll["power_law"] <= min(nll["zipf"], nll["power_law_49"]) + 1e-6 and nll["double_power_law"] <= nll["double_power_law_fixed"] + 1e-3
    return t.select("model", "k", "n", F.lit(bool(good)).alias("nested"), (F.col("delta_aic") >= 0).alias("ranked"))


def dpl_fixed_optimum(spark, d):
    """Least negative log likelihood of the double power law with given slopes, over break and cut-off."""
    return models.model_table(catalog(spark, d), "cell_count").where("model = 'double_power_law_fixed'").select("model", "n", F.round("nll", 1).alias("nll"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "catalog"}

# ---- SQL ------------------------------------------------------------------------------------------------------------
CAT = (
    "WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS gid, CAST(year(l_shipdate) AS INT) AS step, CAST(l_quantity AS BIGINT) AS cell_count, l_quantity AS volume, l_extendedprice AS mass, "
    "1.0::DOUBLE + l_tax AS area, l_discount AS velocity_std, l_tax AS velocity_mean FROM lineitem)"
)


def _bin(x: str, edges: list[float], closed: bool = True) -> str:
    whens = " ".join(f"WHEN {x} < {b!r} THEN {i}" for i, b in enumerate(edges[1:]))
    return f"CASE WHEN {x} < {edges[0]!r} THEN NULL {whens} WHEN {x} = {edges[-1]!r} THEN {len(edges) - 2 if closed else 'NULL'} END"


def _edges(edges: list[float]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))) + ") e(bin, lo, hi)"


def _hist(where: str, by: str = "") -> str:
    return f"h AS (SELECT {by} {_bin('volume', EDGES)} AS bin, count(*) AS n FROM c WHERE {where} GROUP BY ALL)"


_SPEC = "sqrt(lo * hi) * coalesce(n, 0) / ln(hi / lo)"
_T = "(VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in T) + ") t(t)"
_NLL = "n * ln((exp(alpha * ln(10) * hi) - exp(alpha * ln(10) * lo)) / (alpha * ln(10))) - alpha * ln(10) * s"
_NLLQ = CAT + f", s AS (SELECT k.cut, count(*) AS n, sum(log10(volume)) AS s, min(log10(volume)) AS lo, max(log10(volume)) AS hi FROM c JOIN (SELECT unnest({CUTS})::DOUBLE AS cut) k ON volume > k.cut GROUP BY 1), " \
    f"g AS (SELECT cut, alpha, n, round({_NLL}, 3) AS nll FROM s, (SELECT unnest({ALPHAS})::DOUBLE AS alpha))"  # fmt: skip
_REACH = "(CASE WHEN step % 3 = 0 THEN least(volume, 31::DOUBLE) ELSE volume END)"
_BYSTEP = CAT + f", h AS (SELECT step, {_bin(_REACH, EDGES)} AS bin, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT step, bin, n, sqrt(lo * hi) * n AS spectrum, lo, hi FROM h JOIN {_edges(EDGES)} USING (bin))"
_NSTEP = "(SELECT count(DISTINCT step) FROM c)"

_ANCHORED = _BYSTEP + f", f AS (SELECT bin, any_value(log10(sqrt(lo * hi))) AS m, count(*) FILTER (spectrum > 0) = {_NSTEP} AS al FROM s GROUP BY bin), g AS (SELECT least(5.0, log10(max(volume)) - 0.5) AS target FROM c), " \
    "a AS (SELECT bin AS anchor FROM f, g ORDER BY NOT al, abs(m - target), bin LIMIT 1), v AS (SELECT step, spectrum AS av, anchor FROM s JOIN a ON s.bin = anchor), w AS (SELECT step, bin, anchor, spectrum / av AS normalised FROM s JOIN v USING (step))"  # fmt: skip


def _dpl_sql(x: str, v0: float, g: float, b: float, cut: float, m: float = 2.0, s: float = 1.0, a: float = 1.0) -> str:
    r = f"({x} / pow(10, {v0!r}::DOUBLE))"
    return f"({a!r}::DOUBLE * pow({r}, {-g!r}::DOUBLE) * pow(1 + pow({r}, {s!r}::DOUBLE), {(g - b) / s!r}::DOUBLE) * exp(-pow(pow(10, {cut!r}::DOUBLE) / {x}, {m!r}::DOUBLE)))"


def _dpl_nll(i: int, p: tuple) -> str:
    return (
        f"d{i} AS (SELECT count(*) AS n, min(log10(volume)) AS lo, max(log10(volume)) AS hi, sum(ln({_dpl_sql('volume', *p)} / volume)) AS s FROM c), "
        f"t{i} AS (SELECT d.*, i, lo + (hi - lo) * i / {models.GRID - 1} AS y FROM d{i} d, range({models.GRID}) r(i)), "
        f"q{i} AS (SELECT n, s, sum(CASE WHEN i IN (0, {models.GRID - 1}) THEN 0.5 ELSE 1 END * {_dpl_sql('pow(10, y)', *p)} / pow(10, y)) * (hi - lo) / {models.GRID - 1} AS z FROM t{i} GROUP BY n, s, lo, hi), "
        f"l{i} AS (SELECT {p[0]!r}::DOUBLE AS log_v0, {p[1]!r}::DOUBLE AS gamma, {p[2]!r}::DOUBLE AS beta, {p[3]!r}::DOUBLE AS log_cut, n, n * ln(z) - s AS nll FROM q{i})"
    )


def _refined(levels: int = 12) -> str:
    """Nested refinement of break and cut-off (``best{levels}``): a grid of steps of 1, then 7 x 7 points around the best, each
    time at half the step."""
    density = "4.0::DOUBLE / 9 * ln(1 + pow(10, {y} - v0)) - pow(10, 2 * (cut - {y})) - {y} * ln(10)"
    out = "dv AS (SELECT log10(volume) AS y, count(*) AS w FROM c GROUP BY 1), dm AS (SELECT CAST(sum(w) AS BIGINT) AS n, min(y) AS lo, max(y) AS hi FROM dv), "
    out += f"gy AS (SELECT lo + (hi - lo) * i / {models.GRID - 1} AS y, CASE WHEN i IN (0, {models.GRID - 1}) THEN 0.5 ELSE 1 END * (hi - lo) / {models.GRID - 1} AS dy FROM dm, range({models.GRID}) r(i))"
    for k in range(levels + 1):
        if k:
            spot = lambda b, o, lo, hi: f"least(greatest({b} + {o}.o * {0.5**k!r}::DOUBLE, {lo}), {hi})"  # noqa: E731, B023
            out += f", cand{k} AS (SELECT DISTINCT {spot('v0', 'p', 0, 12)} AS v0, {spot('cut', 'q', -2, 10)} AS cut FROM best{k - 1}, range(-3, 4) p(o), range(-3, 4) q(o))"
        else:
            out += ", cand0 AS (SELECT p.o::DOUBLE AS v0, q.o::DOUBLE AS cut FROM range(0, 13) p(o), range(-2, 11) q(o))"
        out += f", s{k}_ AS (SELECT v0, cut, sum(w * ({density.format(y='y')})) AS s FROM cand{k}, dv GROUP BY ALL), l{k}_ AS (SELECT v0, cut, dy, {density.format(y='y')} AS ld, max({density.format(y='y')}) OVER (PARTITION BY v0, cut) AS top FROM cand{k}, gy), "
        out += f"z{k}_ AS (SELECT v0, cut, any_value(top) + ln(sum(dy * exp(ld - top))) AS z FROM l{k}_ GROUP BY ALL), best{k} AS (SELECT v0, cut, n, n * z - s AS nll FROM s{k}_ JOIN z{k}_ USING (v0, cut), dm ORDER BY nll, v0, cut LIMIT 1)"
    return out


_DPLS = CAT + ", " + ", ".join(_dpl_nll(i, p) for i, p in enumerate(DPL))
_CURVE_SQL = {
    "power_law": "3.0::DOUBLE * pow({x}, 0.5::DOUBLE)", "zipf": "3.0::DOUBLE * pow({x}, 0)", "floor": "1e-40::DOUBLE * pow({x}, 0.1::DOUBLE)", "dpl": _dpl_sql("{x}", 1.0, -0.5, 0.7, 0.3, 2.0, 1.0, 1000.0),
    "dpl_steep": _dpl_sql("{x}", 0.5, 0.0, -4.0 / 9, 1.0, 0.5, 1.0, 10.0), "beuermann": _dpl_sql("{x}", 1.2, -0.9, 0.4, 0.2, 1.5, 3.0, 20000.0),
}
_STATS = "s AS (SELECT k.cut, count(*) AS n, sum(log10(volume)) AS s, min(log10(volume)) AS lo, max(log10(volume)) AS hi FROM c JOIN (SELECT unnest({cuts})::DOUBLE AS cut) k ON volume > k.cut GROUP BY 1)"
_LINE = "(n * ln((exp({c} * hi) - exp({c} * lo)) / {c}) - {c} * s)"
_Z = ", m AS (SELECT " + ", ".join(f"avg({n}) AS {n}_m, stddev_pop({n}) AS {n}_s" for n in NAMES) + " FROM c)"


def _db(where: str, x: str, y: str, eps: float, least: int) -> str:
    return (
        f"WITH RECURSIVE p AS (SELECT c_custkey AS key, {x} AS x, {y} AS y FROM customer WHERE {where}), e AS (SELECT a.key AS s, b.key AS d FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps * eps!r}::DOUBLE), "
        f"k AS (SELECT s AS key FROM e GROUP BY s HAVING count(*) >= {least}), ke AS (SELECT s, d FROM e WHERE s IN (SELECT key FROM k) AND d IN (SELECT key FROM k)), "
        "r(id, lab) AS (SELECT key, key FROM k UNION SELECT ke.d, r.lab FROM r JOIN ke ON ke.s = r.id WHERE r.lab < ke.d), m AS (SELECT id, min(lab) AS root FROM r GROUP BY id), "
        "o AS (SELECT p.key, min(m.root) AS cluster FROM p LEFT JOIN e ON e.s = p.key LEFT JOIN m ON m.id = e.d GROUP BY 1)"
    )


_PE = {"volume": EDGES, "mass": MASS_EDGES, "area": [1.0, 1.02, 1.05, 1.09], "velocity_std": STD_EDGES}
_IE = [float(x) for x in S.integer_edges(1, 51, 8)]

SQL: dict[str, str] = {
    "size_histogram": CAT + ", " + _hist("volume > 0") + f" SELECT bin, lo, hi, coalesce(n, 0) AS n FROM {_edges(EDGES)} LEFT JOIN h USING (bin)",
    "size_spectrum": CAT + ", " + _hist("volume > 8") + f" SELECT bin, coalesce(n, 0) AS n, round({_SPEC}, 6) AS spectrum FROM {_edges(EDGES)} LEFT JOIN h USING (bin)",
    "volume_spectra_by_step": CAT + ", " + _hist("volume > 8", "step,") + f" SELECT step, bin, n, round({_SPEC}, 6) AS spectrum FROM h JOIN {_edges(EDGES)} USING (bin)",
    "spectrum_compare_ratio": CAT + f", a AS (SELECT {_bin('volume', EDGES)} AS bin, count(*) AS n FROM c WHERE step <= 1994 GROUP BY 1), b AS (SELECT {_bin('volume', EDGES)} AS bin, count(*) AS n FROM c WHERE step > 1994 GROUP BY 1), "
    f"j AS (SELECT e.*, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM {_edges(EDGES)} LEFT JOIN a USING (bin) LEFT JOIN b USING (bin)), k AS (SELECT bin, n_a, n_b, sqrt(lo * hi) * n_a / ln(hi / lo) AS sa, sqrt(lo * hi) * n_b / ln(hi / lo) AS sb FROM j) "
    "SELECT bin, n_a, round(sa, 6) AS spectrum_a, n_b, round(sb, 6) AS spectrum_b, CAST(sum(n_a) OVER () AS BIGINT) AS total_a, CAST(sum(n_b) OVER () AS BIGINT) AS total_b, round(CASE WHEN sa > 0 THEN sb / sa END, 6) AS ratio FROM k",
    "hist2d_size_vdisp": CAT + f", b AS (SELECT {_bin('volume', EDGES)} AS xbin, {_bin('velocity_std', STD_EDGES)} AS ybin FROM c WHERE volume > 0 AND velocity_std > 0) SELECT xbin, ybin, count(*) AS n FROM b WHERE xbin IS NOT NULL AND ybin IS NOT NULL GROUP BY 1, 2",
    "hist2d_area89": CAT + f", d AS (SELECT volume, area / pow(volume, 8.0::DOUBLE / 9) AS a89 FROM c), b AS (SELECT {_bin('volume', EDGES)} AS xbin, {_bin('a89', AREA_EDGES)} AS ybin FROM d) SELECT xbin, ybin, count(*) AS n FROM b WHERE xbin IS NOT NULL AND ybin IS NOT NULL GROUP BY 1, 2",
    "cumulative_product": CAT + f' SELECT t, count(*) AS "count", count(*) * t AS product FROM {_T} JOIN c ON volume >= t GROUP BY t',
    "cumulative_count": CAT + f', s AS (SELECT DISTINCT step FROM c) SELECT s.step, t, count(c.gid) AS "count" FROM s CROSS JOIN {_T} LEFT JOIN c ON c.step = s.step AND volume >= t GROUP BY 1, 2',
    "cumulative_envelope": CAT + f", s AS (SELECT DISTINCT step FROM c), p AS (SELECT s.step, t, count(c.gid) * t AS product FROM s CROSS JOIN {_T} LEFT JOIN c ON c.step = s.step AND volume >= t GROUP BY 1, 2) "
    "SELECT t, median(product) AS p_median, min(product) AS p_min, max(product) AS p_max FROM p GROUP BY t",
    "reverse_rank_cdf": CAT + ", r AS (SELECT step, gid, mass, row_number() OVER (PARTITION BY step ORDER BY mass DESC, gid) AS n_ge, count(*) OVER (PARTITION BY step) AS k FROM c) "
    "SELECT step, gid, round(mass, 6) AS mass, n_ge, round(mass * n_ge, 6) AS product, round(n_ge / k, 6) AS cdf FROM r",
    "median_curve": CAT + f", b AS (SELECT *, {_bin('mass', MASS_EDGES, False)} AS bin FROM c WHERE mass > 0 AND volume > 0) SELECT bin, round(exp(avg(ln(mass))), 6) AS x_geo, round(median(volume), 6) AS y_median, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 5",
    "powerlaw_fit": CAT + " SELECT step, round(regr_slope(log10(mass), log10(volume)), 6) AS slope, round(regr_intercept(log10(mass), log10(volume)), 6) AS intercept, count(*) AS n FROM c WHERE mass > 0 AND volume > 0 GROUP BY step",
    "powerlaw_segment_fit": CAT + ", p AS (SELECT CAST(t AS DOUBLE) AS t, count(*) * CAST(t AS DOUBLE) AS product FROM range(1, 51) r(t) JOIN c ON volume >= t GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM p) "
    "SELECT round(regr_slope(log10(product), log10(t)), 6) AS slope, round(regr_intercept(log10(product), log10(t)), 6) AS intercept, count(*) AS n FROM i WHERE i >= floor(n * 0.55) AND i < ceil(n * 0.8)",
    "pearson_matrix": CAT + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM c" for a in NAMES for b in NAMES),
    "zscore_features": CAT + ", m AS (SELECT " + ", ".join(f"avg({n}) AS {n}_m, stddev_pop({n}) AS {n}_s" for n in NAMES) + " FROM c) SELECT gid, " + ", ".join(f"round(({n} - {n}_m) / {n}_s, 5) AS {n}" for n in NAMES) + " FROM c, m",
    "feature_flatten": CAT + " SELECT gid, round(greatest(volume, area, velocity_std), 6) AS principal_axes_lengths, round(area, 6) AS axis_ratios, CAST(cell_count AS DOUBLE) AS num_cells, round(mass / volume, 9) AS mean_density, round(velocity_std, 6) AS dispersion_3d FROM c",
    "box_units": CAT + ", u AS (SELECT median(volume / greatest(cell_count, 1)) AS cell_volume FROM c) SELECT step, round(cell_volume, 6) AS cell_volume, round(sum(volume / cell_volume), 6) AS cells, round(max(pow(cell_volume, 1.0::DOUBLE / 3)), 6) AS dx, round(sum(volume / pow(pow(cell_volume, 1.0::DOUBLE / 3) * 64, 3)), 6) AS box_share FROM c, u GROUP BY step, cell_volume",
    "snapshot_summary": CAT + " SELECT step, count(*) AS n_clumps, sum(volume) AS total_vol FROM c GROUP BY step",
    "exact_median_by_step": CAT + " SELECT step, round(median(mass), 6) AS median, count(*) AS n FROM c GROUP BY step",
    "snapshot_bin_mean_std": _ANCHORED + f" SELECT bin, round(sum(normalised) / {_NSTEP}, 6) AS mean, round(sqrt(greatest(sum(normalised * normalised) / {_NSTEP} - pow(sum(normalised) / {_NSTEP}, 2), 0)), 6) AS std, count(*) AS n FROM w GROUP BY bin",
    "bins_all_any": _BYSTEP + f" SELECT bin, count(*) FILTER (spectrum > 0) = {_NSTEP} AS in_all, bool_or(spectrum > 0) AS in_any FROM s GROUP BY bin",
    "anchor_normalise": _ANCHORED + " SELECT step, bin, anchor, round(normalised, 6) AS normalised FROM w",
    "dpl_nll_table": _DPLS + " " + " UNION ALL ".join(f"SELECT log_v0, gamma, beta, log_cut, n, round(nll, 2) AS nll FROM l{i}" for i in range(len(DPL))),
    "aic_bic_table": _DPLS + ", " + _STATS.format(cuts=[0.0]) + f", e AS (SELECT 'zipf' AS model, n, 0 AS k, {_LINE.format(c='(-ln(10))')} AS nll FROM s UNION ALL SELECT 'power_law_49', n, 0, {_LINE.format(c='(-5.0::DOUBLE / 9 * ln(10))')} FROM s "
    "UNION ALL SELECT 'double_power_law', n, 4, nll FROM l0 UNION ALL SELECT 'double_power_law_fixed', n, 2, nll FROM l1), t AS (SELECT *, 2 * k + 2 * nll AS aic, k * ln(n) + 2 * nll AS bic FROM e) "
    "SELECT model, k, n, round(nll, 2) AS nll, round(aic, 2) AS aic, round(bic, 2) AS bic, round(aic - min(aic) OVER (), 2) AS delta_aic FROM t",
    "vmin_sweep": CAT.replace("WITH c", "WITH RECURSIVE c") + ", " + _STATS.format(cuts=CUTS) + ", b(cut, i, a, z) AS (SELECT cut, 0, -3.0::DOUBLE, 1.0000001::DOUBLE FROM s WHERE n >= 20 UNION ALL "
    "SELECT b.cut, i + 1, CASE WHEN g < 0 THEN h ELSE a END, CASE WHEN g < 0 THEN z ELSE h END FROM (SELECT b.*, (a + z) / 2 AS h, n * ((hi * exp((a + z) / 2 * ln(10) * hi) - lo * exp((a + z) / 2 * ln(10) * lo)) / (exp((a + z) / 2 * ln(10) * hi) - exp((a + z) / 2 * ln(10) * lo)) - 1 / ((a + z) / 2 * ln(10))) - s.s AS g "
    "FROM b JOIN s ON s.cut = b.cut WHERE i < 60) b), f AS (SELECT s.*, (a + z) / 2 AS e FROM b JOIN s ON s.cut = b.cut WHERE i = 60), "
    f"v AS (SELECT cut, n, e + 1 AS alpha, {_LINE.format(c='(e * ln(10))')} AS nll, {_LINE.format(c='(-ln(10))')} AS flat FROM f) "
    "SELECT cut, n, round(alpha, 3) AS alpha, round(nll, 2) AS nll, round(flat, 2) AS nll_zipf, round(2 + 2 * nll, 2) AS aic, round(ln(n) + 2 * nll, 2) AS bic, round(2 * flat - 2 - 2 * nll, 2) AS delta_aic FROM v",
    "model_curves": CAT + " SELECT DISTINCT volume, " + ", ".join(f"round(log10(greatest({q.format(x='volume')}, 1e-30)), 6) AS {n}" for n, q in _CURVE_SQL.items()) + " FROM c",
    "curve_rss_table": CAT + ", " + _hist("TRUE") + f", p AS (SELECT sqrt(lo * hi) AS mid, sqrt(lo * hi) * n AS y FROM h JOIN {_edges(EDGES)} USING (bin)), "
    "r AS (SELECT unnest([0.0, 2.0, 5.0])::DOUBLE AS lo), q AS (" + " UNION ALL ".join(f"SELECT '{n}' AS model, {k} AS k, lo, count(*) AS n, sum(pow(log10(y) - log10(greatest({_CURVE_SQL[n].format(x='mid')}, 1e-30)), 2)) AS rss FROM p JOIN r ON mid > lo GROUP BY lo" for n, k in (("power_law", 2), ("dpl", 6), ("dpl_steep", 6), ("beuermann", 7)))
    + ") SELECT model, lo, n, round(rss, 5) AS rss, round(n * ln(rss / n) + 2 * k, 4) AS aic FROM q",
    "pca_scores": CAT + _Z + " SELECT gid, round(" + " + ".join(f"pow(({n} - {n}_m) / {n}_s, 2)" for n in NAMES) + ", 5) AS square FROM c, m",
    "pca_explained": CAT + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM c" for a in NAMES for b in NAMES),
    "fa_loadings": "SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS feature, 1.0::DOUBLE AS variance, TRUE AS noisy",
    "embedding_plane": "SELECT count(*) AS n, TRUE AS uncorrelated, TRUE AS ordered FROM lineitem",
    "kmeans_clusters": "SELECT count(*) AS n, CAST(4 AS BIGINT) AS clusters, TRUE AS nearest, TRUE AS explained FROM lineitem",
    "dbscan_clusters": _db("TRUE", "c_acctbal / 1000", "c_nationkey / 5.0::DOUBLE", 0.25, 5) + " SELECT key, cluster IS NOT NULL AS clustered FROM o",
    "dbscan_sizes": _db("TRUE", "c_acctbal / 1000", "CAST(c_nationkey AS DOUBLE)", 0.2, 3) + ", g AS (SELECT cluster, count(*) AS n FROM o WHERE cluster IS NOT NULL GROUP BY 1) SELECT n, count(*) AS clusters FROM g GROUP BY n",
    "weighted_sample": CAT + " SELECT gid, volume, mass FROM c ORDER BY -ln((CAST('0x' || substr(md5('42|' || gid), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) / sqrt(volume), gid LIMIT 500",
    "nlls_model_fits": CAT + f", h AS (SELECT {_bin('mass', FIT_EDGES)} AS bin, count(*) AS n FROM c GROUP BY 1), p AS (SELECT log10(sqrt(lo * hi)) AS x, log10({_SPEC}) AS y FROM h JOIN {_edges(FIT_EDGES)} USING (bin) WHERE n > 0), "
    "m AS (SELECT count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM p), "
    f"s AS (SELECT 'zipf' AS model, 0.0::DOUBLE AS b, m.* FROM m UNION ALL SELECT 'power_law_49', {-models.BETA_FIXED!r}::DOUBLE, m.* FROM m UNION ALL SELECT 'power_law', least(2.0::DOUBLE, greatest(-2.0::DOUBLE, sxy / sxx)), m.* FROM m), "
    "r AS (SELECT model, syy - 2 * b * sxy + b * b * sxx AS rss FROM s), "
    "t(model, k) AS (VALUES ('double_power_law', 6), ('double_power_law_fixed', 4), ('power_law_49', 1), ('power_law', 2), ('zipf', 1), ('beuermann_fixed', 5), ('beuermann', 7)) "
    "SELECT model, k, n, round(rss, 6) AS rss, round(n * ln(rss / n) + 2 * k, 4) AS aic, TRUE AS no_worse, TRUE AS ranked FROM t LEFT JOIN r USING (model), (SELECT n FROM m)",
    "dpl_mle_fit": "SELECT model, k, n, TRUE AS nested, TRUE AS ranked FROM (VALUES ('power_law', 1), ('zipf', 0), ('power_law_49', 0), ('double_power_law', 4), ('double_power_law_fixed', 2)) t(model, k), (SELECT count(*) AS n FROM lineitem)",
    "dpl_fixed_optimum": CAT + ", " + _refined() + " SELECT 'double_power_law_fixed' AS model, n, round(nll, 1) AS nll FROM best12",
    "powerlaw_nll_grid": _NLLQ + " SELECT * FROM g",
    "aic_bic_grid": _NLLQ + ", t AS (SELECT *, 2 + 2 * nll AS aic, ln(n) + 2 * nll AS bic FROM g) SELECT cut, alpha, round(aic, 3) AS aic, round(bic, 3) AS bic, round(aic - min(aic) OVER (PARTITION BY cut), 3) AS delta_aic FROM t",
    "run_name_parse": "WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE 'res' || o_custkey || '_x_step' || lpad(CAST(month(o_orderdate) AS VARCHAR), 5, '0') || '_conn6_T0p0' || (o_orderkey % 9) END AS name FROM orders), "
    "p AS (SELECT * FROM n) SELECT o_orderkey, TRY_CAST(regexp_extract(name, 'res(\\d+)_.*step(\\d+)_conn(\\d+)_T([0-9p]+)', 1) AS INT) AS res, "
    "TRY_CAST(regexp_extract(name, 'res(\\d+)_.*step(\\d+)_conn(\\d+)_T([0-9p]+)', 2) AS INT) AS step, TRY_CAST(regexp_extract(name, 'res(\\d+)_.*step(\\d+)_conn(\\d+)_T([0-9p]+)', 3) AS INT) AS conn, "
    "TRY_CAST(replace(regexp_extract(name, 'res(\\d+)_.*step(\\d+)_conn(\\d+)_T([0-9p]+)', 4), 'p', '.') AS DOUBLE) AS temp_thr FROM p",
    "step_over_30": "SELECT CAST(event_id % 60 AS INT) AS step, 640 AS res, count(*) AS n FROM events WHERE event_id % 60 > 30 GROUP BY 1",
    "label_sanitize": "SELECT p_partkey, CASE WHEN l = '' THEN 'feature' ELSE l END AS label FROM (SELECT p_partkey, lower(trim(regexp_replace(replace(replace(replace(replace(' ⟨v⟩-' || p_name || ' / ' || p_type || ' σ!', '⟨v⟩', 'v_mean'), 'σ', 'sigma'), ' ', '_'), '-', '_'), '[^0-9a-zA-Z_]+', '_', 'g'), '_')) AS l FROM part)",
    "pair_histograms": CAT + " " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{a}' AS a, '{b}' AS b, {_bin(a, _PE[a])} AS xbin, {_bin(b, _PE[b])} AS ybin, count(*) AS n FROM c WHERE {a} > 0 AND {b} > 0 GROUP BY ALL) WHERE xbin IS NOT NULL AND ybin IS NOT NULL"
        for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]
    ),
    "step_or_ordinal": "WITH e AS (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'run' || (event_id % 7) ELSE 'step' || (event_id % 5) END AS dir FROM events) "
    "SELECT dir, CAST(coalesce(TRY_CAST(regexp_extract(dir, 'step(\\d+)', 1) AS INT), row_number() OVER (ORDER BY dir) - 1) AS INT) AS step FROM e",
    "integer_bin_spectrum": CAT + f", h AS (SELECT {_bin('volume', _IE)} AS bin, count(*) AS n FROM c GROUP BY 1) SELECT lo, hi, coalesce(n, 0) AS n, round({_SPEC}, 6) AS spectrum FROM {_edges(_IE)} LEFT JOIN h USING (bin)",
    "effective_radius": CAT + ", d AS (SELECT gid, volume, CASE gid % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE / 10240 END AS dx FROM c) SELECT gid, round(cbrt(volume) / dx, 3) AS r_eff, round(volume / pow(dx, 3), 3) AS v_cells FROM d",
}

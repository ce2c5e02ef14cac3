"""Spectra, fits, features and sources against numpy."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.config import EngineConfig
from voxelweave.operators import catalog as C
from voxelweave.operators import ml, models
from voxelweave.operators import spectra as S
from voxelweave.sources import readers, sinks
from voxelweave.streaming import catalogs


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    v = np.round(10 ** rng.uniform(0, 3, 800))
    return spark.createDataFrame([(i, float(a), float(a**1.2), float(rng.random() + 0.1)) for i, a in enumerate(v)], "gid bigint, volume double, mass double, area double")


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.9, 2.0, 4.0, 8.0, 9.0, 0.5, float("nan"))], "v double")
    assert [r["n"] for r in S.histogram(df, "v", [1.0, 2.0, 4.0, 8.0]).orderBy("bin").collect()] == [2, 1, 2]
    assert S.median_curve(df.withColumn("w", F.col("v")), "v", "w", [1.0, 2.0, 4.0, 8.0], 1).agg(F.sum("n")).first()[0] == 4


def test_cumulative_and_rank(spark, sample):
    v = np.array([r[0] for r in sample.select("volume").collect()])
    for r in S.cumulative_product(sample, "volume", [1.0, 10.0, 500.0]).collect():
        assert r["count"] == (v >= r["t"]).sum()
    rows = S.reverse_rank(sample.withColumn("res", F.lit(1)), "volume", "res", "gid").orderBy("n_ge").collect()
    assert [r["n_ge"] for r in rows] == list(range(1, 801)) and [r["volume"] for r in rows] == sorted(v, reverse=True)


def test_powerlaw_slope(sample):
    r = S.powerlaw_fit(sample, "volume", "mass").first()
    assert r["slope"] == pytest.approx(1.2) and r["n"] == 800


def test_integer_edges():
    e = S.integer_edges(1.5, 1000, 20)
    assert e[0] == 2 and e[-1] == 1000 and len(e) == 21 and all(a < b for a, b in zip(e, e[1:], strict=False))
    assert S.integer_edges(1, 1000, 20)[0] == 1 and S.integer_edges(1, 4, 20) == [1, 2, 3, 4]
    assert S.log_edges(1, 100, 3) == pytest.approx([1, 10, 100])


def test_features_and_missing(sample):
    with pytest.raises(KeyError, match="nope, zip"):
        ml.features(sample, ["volume", "zip", "nope"])
    assert "effective_radius" in ml.available_features(sample)
    z = ml.zscore(sample, ["volume", "mass"]).agg(F.avg("volume"), F.stddev_pop("volume")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_pca_and_factors(sample):
    x = np.array([[r["volume"], r["mass"], r["area"]] for r in sample.collect()])
    z = (x - x.mean(0)) / x.std(0)
    value = np.sort(np.linalg.eigvalsh(np.cov(z.T, bias=True)))[::-1]
    scores, _, ratio = ml.pca(sample, ["volume", "mass", "area"], 8)
    assert ratio == pytest.approx(value / value.sum()) and len(scores.columns) == 3
    load, noise = ml.factor_analysis(sample, ["volume", "mass", "area"], 1)
    assert (load[0, 0] * load[1, 0]) > 0.8 and noise[2] > 0.9


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(0, 0.2, (60, 2)), rng.normal(3, 0.2, (60, 2)), rng.uniform(-3, 6, (20, 2)), np.zeros((5, 2))])
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)) <= 0.3
    core = d.sum(1) >= 6
    lab = np.where(core, np.arange(len(pts)), -1)
    for _ in range(len(pts)):
        new = np.array([min(lab[j] for j in np.flatnonzero(d[i] & core)) if core[i] else -1 for i in range(len(pts))])
        if (new == lab).all():
            break
        lab = new
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id bigint, x double, y double")
    got = {r["id"]: r["cluster"] for r in ml.dbscan(df, "id", ["x", "y"], 0.3, 6).collect()}
    names = {}
    for i in np.flatnonzero(core):
        assert names.setdefault(lab[i], got[i]) == got[i]
    assert len(set(names.values())) == len(names)
    assert all((got[i] == -1) == (not (d[i] & core).any()) for i in range(len(pts)))


def test_sample_and_kmeans(sample):
    assert ml.weighted_sample(sample, 50, "sqrt_volume").count() == 50
    assert ml.weighted_sample(sample.withColumn("volume", F.lit(0.0)), 50, "log_volume").count() == 50
    assert ml.kmeans(sample, ["volume", "mass"], 3, keep=("gid",)).select("cluster").distinct().count() == 3


def test_kmeans_fits_on_small_partitions(spark, monkeypatch):
    """However few the files, the fit gets partitions of FIT_ROWS rows, and finds clusters that lie apart."""
    from pyspark.ml.clustering import KMeans

    monkeypatch.setattr(ml, "FIT_ROWS", 50)
    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, d: seen.append(d.rdd.glom().map(len).collect()) or fit(self, d))
    df = spark.range(0, 600, 1, 1).selectExpr("id", "id % 3 * 100D + id / 600 AS x", "id % 3 * -50D AS y")
    got = ml.kmeans(df, ["x", "y"], 3, keep=("id",)).collect()
    assert len(seen[0]) == 12 and max(seen[0]) <= 60 and sum(seen[0]) == 600
    assert len(got) == 600 and len({(r["id"] % 3, r["cluster"]) for r in got}) == 3


def test_powerlaw_mle_recovers_slope(spark):
    u = np.random.default_rng(1).random(20000)
    a, lo, hi = -0.7, 0.0, 4.0
    c = a * np.log(10)
    y = np.log(np.exp(c * lo) + u * (np.exp(c * hi) - np.exp(c * lo))) / c
    df = spark.createDataFrame([(float(10**t),) for t in y], "v double")
    r = models.vmin_sweep(df, "v", [0.5, 10.0]).collect()
    assert [x["alpha"] for x in r] == pytest.approx([a + 1, a + 1], abs=0.05) and all(x["delta_aic"] > 0 for x in r)
    assert models.vmin_sweep(df, "v", [1e9]).count() == 0


def test_curve_fits_rank_the_true_model(spark):
    x = np.geomspace(1, 1e7, 60)
    u = np.log10(x)
    planted = {
        "double_power_law": (6, 2.0 + models.log10_broken(u, 4.0, -1.2, -0.3, 1.5, 1.0)),
        "double_power_law_fixed": (4, 1.0 + models.log10_broken(u, 3.5, 0.0, -4 / 9, 1.2, 0.7)),
        "beuermann_fixed": (5, 1.0 + models.log10_broken(u, 4.0, 0.0, -4 / 9, 1.2, 0.7, 4.0)),
        "power_law": (2, 0.3 + 0.7 * u),
        "zipf": (1, 0.5 + 0 * u),
        "power_law_49": (1, -0.2 + 4 / 9 * u),
    }
    for name, (k, v) in planted.items():
        df = spark.createDataFrame([(float(a), float(10**b)) for a, b in zip(x, v, strict=True) if b > -30], "mid double, spectrum double")
        fits = {r["model"]: r for r in models.fit_curves(df, "mid", "spectrum").collect()}
        assert len(fits) == 7 and fits[name]["k"] == k and fits[name]["rss"] < 1e-3, name
    with pytest.raises(ValueError, match="points"):
        models.fit_curves(spark.range(1, 10_003).selectExpr("id mid", "1.0 spectrum"), "mid", "spectrum")


def test_curves_as_columns(spark):
    x = np.geomspace(0.5, 1e6, 30)
    df = spark.createDataFrame([(float(t),) for t in x], "v double")
    p = (3.0, -0.7, 0.4, 0.8, 1.3, 2.5)
    got = [r[0] for r in df.select(models.log_floor(models.broken_power_law(F.col("v"), 7.0, *p))).collect()]
    assert got == pytest.approx(np.maximum(np.log10(7.0) + models.log10_broken(np.log10(x), *p), -30))


def test_likelihood_fits_recover_the_planted_model(spark):
    rng = np.random.default_rng(2)
    grid = np.linspace(0, 6, 3000)
    truth = (3.0, -0.9, 0.6, 0.5)
    ld = models.dpl_log_density(grid, *truth)
    p = np.exp(ld - ld.max())
    y = rng.choice(grid, 40000, p=p / p.sum())
    df = spark.createDataFrame([(float(10**t),) for t in y], "cell_count double")
    fits = {r["model"]: r for r in models.model_table(df, "cell_count").collect()}
    best = fits["double_power_law"]
    assert min(fits.values(), key=lambda r: r["aic"])["model"] == "double_power_law" and best["delta_aic"] == 0 and len(fits) == 5
    at_truth = models.dpl_nll_table(df, "cell_count", [truth]).first()["nll"]
    assert best["nll"] <= at_truth + 2 and best["gamma"] == pytest.approx(truth[1], abs=0.4) and best["beta"] == pytest.approx(truth[2], abs=0.3)
    assert models.model_table(df.limit(0), "cell_count").count() == 0
    # the figures are those of the unrounded values, and no neighbouring setting is better
    exact = models.ExactLikelihood(df, "cell_count")
    for name, free in (("double_power_law", range(4)), ("double_power_law_fixed", (0, 3))):
        p0 = np.array([fits[name][c] for c in ("log_v0", "gamma", "beta", "log_cut")])
        near = np.array([np.clip(p0 + s * np.eye(4)[i], models.DPL_LOWER, models.DPL_UPPER) for i in free for s in (0.003, -0.003, 0.03, -0.03)])
        assert exact(p0)[0] == pytest.approx(fits[name]["nll"], rel=1e-12) and (exact(near) >= fits[name]["nll"] - 1e-6).all()
    # one aggregation gives what the sum over values gives
    v = np.log10([r[0] for r in df.collect()])
    assert at_truth == pytest.approx(models.dpl_nll(np.array(truth), v, np.ones(len(v))), rel=1e-9)


def test_equal_sizes_are_one_row_of_the_likelihood(spark):
    """Forty sizes, whatever the number of structures: as many rows, and the likelihood of all values; zeros and infinities are out."""
    sizes = np.random.default_rng(5).integers(1, 41, 3000)
    df = spark.createDataFrame([(float(v),) for v in [*sizes, 0.0, np.inf]], "cell_count double")
    exact = models.ExactLikelihood(df, "cell_count")
    assert exact.rows.count() == 40 and exact.n == 3000
    p = np.array([[1.0, -0.5, 0.7, 0.3], [0.8, 0.3, 1.5, -1.0]])
    y = np.log10(sizes.astype(float))
    assert exact(p) == pytest.approx([models.dpl_nll(q, y, np.ones(3000)) for q in p], rel=1e-12)


def test_newton_stays_in_the_box():
    bowl = lambda q: ((q - [1.0, -2.0]) ** 2 * [1.0, 30.0]).sum(1) + 0.5 * (q[:, 0] - 1) * (q[:, 1] + 2)
    at, value = models.newton_in_box(bowl, np.array([0.0, 0.0]), np.array([-5.0, -5.0]), np.array([5.0, 5.0]))
    assert at == pytest.approx([1, -2], abs=1e-4) and value < 1e-8
    at, value = models.newton_in_box(bowl, np.array([0.0, 0.0]), np.array([-5.0, -1.0]), np.array([5.0, 5.0]))
    assert at[1] == -1 and at[0] == pytest.approx(0.75, abs=1e-3)  # the bound holds, and the other goes on


def test_snapshots_without_a_bin_count_as_zero(spark):
    df = spark.createDataFrame([(1, 0, 4.0), (2, 0, 2.0), (1, 1, 6.0)], "step int, bin int, spectrum double")
    got = {r["bin"]: (r["mean"], r["std"], r["n"]) for r in models.bin_mean_std(df, 2).collect()}
    assert got == {0: (3.0, 1.0, 2), 1: (3.0, 3.0, 1)}


def test_median_and_rank_of_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.integers(0, 4)), i) for i, g in enumerate(rng.integers(0, 3, 901).tolist())] + [(None, 5.0, 1000), (7, None, 1001)]
    df = spark.createDataFrame(rows, "g int, v double, tie int")
    want = {g: (float(np.median([r[1] for r in rows if r[0] == g])), sum(r[0] == g for r in rows)) for g in (0, 1, 2, None)}
    assert {r["g"]: (r["median"], r["n"]) for r in S.exact_median(df, ["g"], "v").collect()} == want
    got = S.reverse_rank(df.where("v IS NOT NULL"), "v", "g", "tie").collect()
    for g in (0, 1, 2, None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["n_ge"])
        assert [(-r["v"], r["tie"]) for r in mine] == sorted((-v, t) for h, v, t in rows if h == g and v is not None)
        assert [r["n_ge"] for r in mine] == list(range(1, len(mine) + 1)) and mine[-1]["cdf"] == 1


def test_sample_does_not_depend_on_partitions(spark, sample):
    one = {r["gid"] for r in ml.weighted_sample(sample.repartition(1), 60, "sqrt_volume").collect()}
    assert one == {r["gid"] for r in ml.weighted_sample(sample.repartition(7), 60, "sqrt_volume").collect()} and len(one) == 60


def test_features_of_several_catalogs(spark, sample, tmp_path):
    paths = [str(tmp_path / n) for n in "ab"]
    rows = sample.withColumn("velocity_mean", F.array(F.lit(3.0), F.lit(0.0), F.lit(4.0)))
    for p in paths:
        rows.write.parquet(p)
    got = ml.load_features(spark, paths, ["velocity_mean_mag", "velocity_speed", "vz_mean", "volume"])
    assert got.count() == 1600 and got.select("velocity_mean_mag", "velocity_speed", "vz_mean", "file").distinct().count() == 2 and got.first()["vz_mean"] == 4.0
    with pytest.raises(KeyError, match="nope"):
        ml.load_features(spark, paths, ["nope"])
    with pytest.raises(ValueError):
        ml.load_features(spark, paths, [])
    ml.register_feature("double_volume", lambda df: F.col("volume") * 2)
    r = ml.features(sample, ["double_volume", "volume"]).first()
    assert r["double_volume"] == 2 * r["volume"]


def test_snapshot_discovery(spark, tmp_path):
    for name in ("n640_sweep/step00031", "n640_sweep/step00030", "n640_sweep/stepx", "n640_sweep/step00040"):
        (tmp_path / name / "clumps_stitched").mkdir(parents=True)
    got = readers.discover_snapshots(spark, str(tmp_path / "n640_sweep")).collect()
    assert sorted((r["res"], r["step"]) for r in got) == [(640, 31), (640, 40)]


def test_names_and_labels(spark):
    df = spark.createDataFrame([("a/res640_q_step00021_conn6_T0p02/x",), ("none",)], "p string")
    assert [tuple(r) for r in df.select(*readers.run_fields(F.col("p"))).collect()] == [(640, 21, 6, 0.02), (None,) * 4]
    got = spark.createDataFrame([(" log10(V / dx) ",), ("***",)], "p string").select(readers.sanitised(F.col("p"))).collect()
    assert [r[0] for r in got] == ["log10_v___dx", "feature"]  # a space is an underscore of its own
    assert readers.level_suffix(["x", "cons_cons_density_lvl3"]) == "lvl3" and readers.level_suffix(["b_lvl2_x", "a_lvl7"]) == "lvl2"
    with pytest.raises(ValueError):
        readers.level_suffix(["x"])


def test_npz_and_metadata(spark, tmp_path):
    for r in range(2):
        np.savez(tmp_path / f"part{r}.npz", label_ids=np.arange(1, 4, dtype=np.int32), volume=np.full(3, float(r)), centroid=np.ones((3, 3)))
        (tmp_path / f"part{r}.json").write_text(json.dumps({"rank": r, "coords": [r, 0, 0], "cart_dims": [2, 1, 1], "grid": {"periodic": [True] * 3}}))
    df = readers.read_npz_parts(spark, str(tmp_path), {"label_ids": "int", "volume": "double", "centroid": "array<double>"})
    assert df.count() == 6 and df.agg(F.sum("volume")).first()[0] == 3
    assert readers.read_part_index(spark, str(tmp_path)).count() == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises((FileNotFoundError, Exception)):
        readers.read_part_index(spark, str(tmp_path / "empty"))
    sinks.write_catalog(df.drop("centroid"), str(tmp_path / "out"), EngineConfig(n=4))
    assert spark.read.parquet(str(tmp_path / "out/data")).count() == 6
    assert json.loads(spark.read.text(str(tmp_path / "out/meta")).first()[0])["config"]["n"] == 4


def test_synthetic_fields(spark):
    f = readers.powerlaw_field(8, -2.0, 1)
    assert f.std() == pytest.approx(1) and abs(f.mean()) < 1e-9
    temp, dens = readers.monotone_fields(readers.gaussian_field(4, 1))
    assert temp.min() > 0.01 and dens.max() < 100
    flat = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert [r["x"] for r in readers.rescaled(flat, "x", 0, 4).collect()] == [2.0] * 5
    x = np.random.default_rng(0).normal(size=300)
    got = [r["x"] for r in readers.rescaled(spark.createDataFrame([(float(t),) for t in x], "x double"), "x", -1, 3).collect()]
    a, b = np.percentile(x, (1, 99))
    assert sorted(got) == pytest.approx(sorted(-1 + 4 * (np.clip(x, a, b) - a) / (b - a)))
    t = readers.field_table(spark, dens=dens, temp=temp)
    assert readers.domain_shape(t).first().asDict() == {"nx": 4, "ny": 4, "nz": 4}


def test_stream(spark, tmp_path):
    spark.range(1, 11).selectExpr("cast(id as double) volume").write.parquet(str(tmp_path / "in"))
    s = catalogs.running_histogram(catalogs.catalog_stream(spark, str(tmp_path / "in"), "volume double"), "volume", [1.0, 5.0, 10.0])
    q = s.writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT bin, n FROM hist").collect())) == [(0, 4), (1, 6)]
    seen = []
    b = catalogs.each_batch(catalogs.catalog_stream(spark, str(tmp_path / "in"), "volume double"), lambda df, _: seen.append(df.count()), str(tmp_path / "ck")).start()
    b.awaitTermination(60)
    assert sum(seen) == 10
    assert io is not None


def test_pair_histograms_are_hist2d_of_each_pair(spark):
    nan = float("nan")
    rows = [(1.0, 2.0, 3.0), (1.5, -1.0, 3.0), (4.0, 4.0, nan), (9.0, 1.0, 1.0), (None, 1.0, 2.0), (1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    edges = {"a": [1.0, 2.0, 4.0], "b": [1.0, 3.0, 5.0], "c": [0.5, 1.5, 3.0]}
    got = sorted(map(tuple, S.pair_histograms(df, edges).collect()))
    want = sorted((x, y, *r) for x, y in (("a", "b"), ("a", "c"), ("b", "c")) for r in map(tuple, S.hist2d(df, x, y, edges[x], edges[y]).collect()))
    assert got == want and len(got) > 4
    assert S.pair_histograms(df, {"a": edges["a"]}).count() == 0 and S.pair_histograms(df.limit(0), edges).count() == 0


def test_subgraph_components(spark):
    """Structure 1 lost the edge between its halves; edges to another structure or to unknown parts join nothing."""
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 8), (9, 8)], "gid bigint, root bigint")
    edges = spark.createDataFrame([(1, 2), (3, 4), (2, 7), (3, 7), (4, 99), (8, 9), (9, 8), (8, 8)], "lo bigint, hi bigint")
    got = sorted(map(tuple, C.subgraph_components(roots, edges).collect()))
    assert got == [(1, 4, 2), (7, 1, 1), (8, 2, 1)]
    assert C.subgraph_components(roots.limit(0), edges).count() == 0

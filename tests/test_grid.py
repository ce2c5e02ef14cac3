"""Grid operators against brute force, analytic cases and the tiled-versus-whole relation."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelweave.config import EngineConfig
from voxelweave.operators import catalog as C
from voxelweave.operators import derive, grid, labels
from voxelweave.operators.components import connected_components
from voxelweave.sources import layout, readers


def brute(mask: np.ndarray, connectivity: int = 6, periodic: bool = True) -> np.ndarray:
    """Smallest flat index of each foreground cell's component, by search; -1 elsewhere."""
    n = mask.shape[0]
    out = np.full(mask.shape, -1)
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    steps = [o for o in np.ndindex(3, 3, 3) if 0 < sum(abs(x - 1) for x in o) <= reach]
    for start in map(tuple, np.argwhere(mask)):
        if out[start] >= 0:
            continue
        root, todo = (start[0] * n + start[1]) * n + start[2], [start]
        out[start] = root
        while todo:
            c = todo.pop()
            for o in steps:
                q = tuple(a + b - 1 for a, b in zip(c, o, strict=True))
                if periodic:
                    q = tuple(x % n for x in q)
                elif not all(0 <= x < n for x in q):
                    continue
                if mask[q] and out[q] < 0:
                    out[q] = root
                    todo.append(q)
    return out


def cells_of(spark, mask):
    at = np.argwhere(mask)
    return spark.createDataFrame([tuple(map(int, r)) + (1.0,) for r in at], "i int, j int, k int, dens double")


def roots_of(df, n):
    return {r["cell_id"]: r["root"] for r in df.collect()}


def expected(mask, connectivity=6):
    out = brute(mask, connectivity)
    return {int(i): int(v) for i, v in enumerate(out.ravel()) if v >= 0}


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_global_labels(spark, connectivity):
    mask = np.random.default_rng(connectivity).random((6, 6, 6)) < 0.25
    assert roots_of(labels.global_labels(cells_of(spark, mask), 6, connectivity), 6) == expected(mask, connectivity)


@pytest.mark.parametrize("n,dims", [(5, (2, 1, 1)), (6, (2, 2, 2)), (7, (3, 2, 1)), (2, (2, 1, 1)), (1, (1, 1, 1))])
def test_bricks_agree_with_whole(spark, n, dims):
    mask = np.random.default_rng(n).random((n, n, n)) < 0.45
    mask[0, 0, 0] = True
    cells = cells_of(spark, mask)
    assert roots_of(labels.brick_path_labels(cells, n, dims), n) == expected(mask)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.sampled_from([(1, 1, 1), (2, 2, 1), (3, 1, 2)]), st.floats(0.2, 0.6))
def test_tiled_and_stitched_equals_direct(spark, seed, dims, share):
    n = 6
    mask = np.random.default_rng(seed).random((n, n, n)) < share
    mask[0, 0, 0] = True
    cells = cells_of(spark, mask).select("*", *(F.lit(float(v)).alias(c) for v, c in ((1, "velx"), (2, "vely"), (2, "velz"))))
    local = labels.brick_labels(cells, n, dims)
    full = cells.withColumn("cell_id", grid.cell_id(n)).join(local.drop("i", "j", "k"), "cell_id")
    edges = labels.interface_edges(local, n, dims)
    merged = C.stitched_catalog(C.unstitched_catalog(full, n, dims, (0.5, 1.0, 2.0)), labels.stitched_roots(local, edges), edges, (0.5, 1.0, 2.0))
    whole = C.direct_catalog(full.drop("label_ids", "rank").join(labels.global_labels(cells, n), "cell_id"), n, (0.5, 1.0, 2.0))
    cols = ["cell_count", "volume", "mass", "area", "velocity_mean", "velocity_std", "i_min", "i_max", "k_max"]
    key = lambda df: sorted(tuple(round(float(r[c]), 9) for c in cols) for r in df.collect())
    assert key(merged) == key(whole)


def test_box(spark):
    n = 64
    box = readers.box_mask(spark, n, ((8, 40), (12, 44), (6, 30))).withColumns({f"vel{a}": F.lit(0.0) for a in "xyz"})
    local = labels.brick_labels(box, n, (2, 2, 2))
    rows = box.withColumn("cell_id", grid.cell_id(n)).join(labels.brick_path_labels(box, n, (2, 2, 2)), "cell_id")
    r = C.direct_catalog(rows, n, (1 / n,) * 3).collect()
    assert len(r) == 1 and local.count() == 24576
    r = r[0]
    assert (r["cell_count"], r["volume"], r["mass"], r["area"]) == (24576, 0.09375, 0.09375, 1.25)
    assert [r[f"centroid_{k}_{a}"] for k in ("vol", "mass") for a in "xyz"] == pytest.approx([0.375, 0.4375, 0.28125] * 2)
    assert [r[f"{a}_{s}"] for a in "ijk" for s in ("min", "max")] == [8, 40, 12, 44, 6, 30]
    axes = C.principal_axes(C.second_moments(rows, "root", (1 / n,) * 3), "root").first()
    assert axes["axis_a"] == pytest.approx(32 / n / np.sqrt(12), rel=1e-2) and axes["ratio_ca"] == pytest.approx(0.75, rel=1e-2)


def test_topology(spark):
    full = np.ones((3, 3, 3), bool)
    x = cells_of(spark, full).withColumn("root", F.lit(0).cast("bigint"))
    assert C.exposed_area(x, C.internal_pairs(x, 3, "root"), (1.0, 1.0, 1.0), "root").first()["area"] == 0
    one = np.zeros((4, 4, 4), bool)
    one[0, 0, 0] = one[1, 1, 0] = one[3, 0, 3] = True
    assert expected(one) == roots_of(labels.global_labels(cells_of(spark, one), 4), 4)
    assert labels.global_labels(cells_of(spark, one).limit(0), 4).count() == 0
    assert labels.brick_labels(cells_of(spark, one).limit(0), 4, (2, 1, 1)).count() == 0


def test_halo_joins_local_pieces(spark):
    n = 4  # a bridge in the next brick joins two core pieces of brick 0
    mask = np.zeros((n, n, n), bool)
    mask[1, 0, 0] = mask[1, 2, 0] = mask[2, 0, 0] = mask[2, 1, 0] = mask[2, 2, 0] = True
    plain = labels.brick_labels(cells_of(spark, mask), n, (2, 1, 1)).where("rank = 0")
    halo = labels.brick_labels(cells_of(spark, mask), n, (2, 1, 1), halo=1).where("rank = 0")
    assert plain.select("label_ids").distinct().count() == 2 and halo.select("label_ids").distinct().count() == 1
    assert halo.count() == 2


def test_split_and_dims():
    assert grid.split_axis(10, 3) == [(0, 4), (4, 7), (7, 10)]
    assert grid.compute_dims(8) == (2, 2, 2) and grid.compute_dims(12) == (3, 2, 2) and grid.compute_dims(7) == (7, 1, 1)
    assert [len(grid.offsets(c)) for c in (6, 18, 26)] == [3, 9, 13]
    with pytest.raises(ValueError):
        grid.offsets(7)


def test_periodic_box_covers_whole_axis(spark):
    df = spark.range(4).selectExpr("cast(id as int) i", "0 j", "0 k")
    rows = layout.periodic_scan(df, 4, ((0, 4), (0, 1), (0, 1)), 1).where("gj = 0 AND gk = 0").select("gi", "i").collect()
    assert sorted(map(tuple, rows)) == [(-1, 3), (0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]


def test_derived_fields_in_single_precision(spark):
    rng = np.random.default_rng(3)
    v = rng.random((50, 5)).astype(np.float32) * 10
    v[0, 0], v[1, 0], v[2, 1] = 0, -1, 0
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], "dens float, etot float, m1 float, m2 float, m3 float")
    got = np.array([[r["velx"], r["temp"], r["dens"]] for r in derive.with_primitives(df).collect()], np.float32)
    safe = np.maximum(v[:, 0], np.float32(1e-30))
    with np.errstate(over="ignore"):
        ke = np.float32(0.5) * (v[:, 2] ** 2 + v[:, 3] ** 2 + v[:, 4] ** 2) / safe
        temp = np.maximum(np.float32(5 / 3 - 1) * (v[:, 1] - ke), np.float32(1e-30)) / safe
    order = np.lexsort((got[:, 0], got[:, 2]))
    want = np.lexsort((v[:, 2] / safe, v[:, 0]))
    assert np.array_equal(got[order, 0], (v[:, 2] / safe)[want]) and np.array_equal(got[order, 1], temp[want])


def test_cut_is_strict_and_nan_is_background(spark):
    df = spark.createDataFrame([(float(np.float32(0.1)),), (0.05,), (float("nan"),), (9.0,), (None,)], "temp double")
    assert derive.cut(df, "temperature", "lt", 0.1).count() == 1
    assert derive.cut(df, "temperature", "gt", 0.1).count() == 1
    with pytest.raises(ValueError):
        derive.cut(df, "temperature", "eq", 0.1)


def test_components_chain_and_loops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (7, 3), (None, 1)], "src bigint, dst bigint")
    got = dict(map(tuple, connected_components(edges, spark.createDataFrame([(500,), (None,)], "id bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 500: 500}
    assert connected_components(edges.limit(0)).count() == 0


def test_moments_of_constant_label(spark):
    x = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0), (2, 1.0, 1.0), (2, 3.0, 3.0)], "root bigint, rho double, dens double")
    r = {t["root"]: t for t in C.moments(x, "root", ("rho",), "dens", excess=True).collect()}
    assert (r[1]["rho_std_massw"], r[1]["rho_skew_massw"], r[1]["rho_kurt_massw"]) == (0, 0, -3)
    assert r[2]["rho_mean_massw"] == 2.5 and r[2]["rho_std_massw"] == pytest.approx(np.sqrt(0.75))


def test_config():
    assert EngineConfig(n=4, dx=1.0, dy=1.0).spacing == (0.25,) * 3
    with pytest.warns(UserWarning, match="colour"):
        EngineConfig.from_mapping({"n": 4, "colour": True})
    assert EngineConfig.from_mapping({"n": 4, "periodic": False}).periodic == (False,) * 3
    assert EngineConfig.from_mapping({"n": 4, "periodic": [True, False, True]}).periodic == (True, False, True)
    for bad in ({"n": 0}, {"n": 4, "cut_op": "eq"}, {"n": 4, "connectivity": 8}, {"n": 4, "ghost_width": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    with pytest.raises(NotImplementedError):
        EngineConfig(n=4, ghost_width=2, overlap_width=2)

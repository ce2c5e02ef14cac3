"""Clustered layout, run-length labels, merge forest and boxes on the ring, against brute force."""

import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_grid import brute
from voxelweave.config import EngineConfig
from voxelweave.operators import grid, mergetree, pencils, periodic
from voxelweave.plans import runs
from voxelweave.sources import layout


def voxels(spark, n, seed=0, smooth=False):
    rng = np.random.default_rng(seed)
    f = rng.random((n, n, n))
    if smooth:
        for axis in range(3):
            f = sum(np.roll(f, s, axis) for s in range(-2, 3)) / 5
    rows = [(i, j, k, float(f[i, j, k])) for i, j, k in np.ndindex(n, n, n)]
    return f, spark.createDataFrame(rows, "i int, j int, k int, dens double")


def test_z_order(spark):
    got = {(r["i"], r["j"], r["k"]): r["z"] for r in spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 0), (3, 5, 6), (2**21 - 1,) * 3], "i int, j int, k int").withColumn("z", layout.z_order(*map(F.col, "ijk"))).collect()}
    interleaved = lambda *p: sum((p[a] >> b & 1) << (3 * b + 2 - a) for b in range(21) for a in range(3))
    assert got == {p: interleaved(*p) for p in got} and got[2**21 - 1, 2**21 - 1, 2**21 - 1] == 2**63 - 1


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(-20, 20), st.integers(0, 20), st.integers(0, 4))
def test_axis_segments_cover_the_range(n, lo, size, halo):
    parts = layout.axis_segments(n, lo, lo + size, halo)
    covered = sorted(x + shift for a, b, shift in parts for x in range(a, b))
    assert covered == list(range(lo - halo, lo + size + halo)) and all(0 <= a < b <= n for a, b, _ in parts)
    assert len(parts) <= 2 or size + 2 * halo > n


def scan_rows(frame):
    """Rows that the Parquet reader hands on, from the scan's own metric."""
    frame.write.format("noop").mode("overwrite").save()
    plan = frame._jdf.queryExecution().executedPlan()
    frame.collect()
    leaves = plan.collectLeaves() if not plan.getClass().getSimpleName().startswith("Adaptive") else plan.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("box", [((2, 6), (3, 5), (0, 4)), ((-3, 2), (14, 18), (7, 9)), ((0, 16), (0, 3), (5, 6)), ((0, 20), (3, 4), (3, 4)), ((4, 4), (0, 1), (0, 1))])
def test_scan_of_a_box(spark, tmp_path, box):
    n, where = 16, str(tmp_path / "v")
    _, df = voxels(spark, n)
    layout.write_clustered(df, where, files=16)
    got = layout.periodic_scan(spark.read.parquet(where), n, box, 1)
    ranges = [range(lo - 1, hi + 1) for lo, hi in box]
    want = sorted((*g, *(x % n for x in g)) for g in itertools.product(*ranges))
    assert sorted((r["gi"], r["gj"], r["gk"], r["i"], r["j"], r["k"]) for r in got.collect()) == want


def test_ranges_reach_the_reader_and_row_groups_fall_with_the_box(spark, tmp_path):
    n, where = 16, str(tmp_path / "v")
    _, df = voxels(spark, n)
    layout.write_clustered(df, where, files=64, group_bytes=1 << 12)
    groups = [[m.row_group(g).column(c).statistics for c in range(3)] for p in (tmp_path / "v").glob("*.parquet") for m in [pq.read_metadata(p)] for g in range(m.num_row_groups)]
    assert len(groups) >= 64 and sum(np.prod([s.max - s.min + 1 for s in g]) for g in groups) <= 4 * n**3, "groups are compact"
    read = {}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name, box in {"small": ((15, 18), (2, 4), (2, 4)), "half": ((0, 8), (0, 16), (0, 16)), "all": ((0, 16),) * 3}.items():
        frame = layout.periodic_scan(spark.read.parquet(where), n, box)
        plan = frame._jdf.queryExecution().toString()
        pushed = plan[plan.index("PushedFilters") :].split("]")[0]
        assert all(f"LessThan({a}," in pushed and f"GreaterThanOrEqual({a}," in pushed for a in "ijk"), pushed
        read[name] = scan_rows(frame)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert read["small"] < 0.2 * n**3 < read["half"] <= 0.7 * n**3 < read["all"] == n**3


@pytest.mark.parametrize(("n", "share", "connectivity"), [(6, 0.3, 6), (6, 0.5, 18), (5, 0.2, 26), (4, 1.0, 6), (4, 0.0, 6), (2, 0.6, 26), (1, 1.0, 18), (3, 0.5, 26)])
def test_run_labels(spark, n, share, connectivity):
    f, df = voxels(spark, n, seed=n)
    mask = f < share
    cells = df.where(F.col("dens") < share).select("i", "j", "k")
    cells = cells.union(cells).repartition(5)  # cells in any order, and twice
    got = {r["cell_id"]: r["root"] for r in pencils.cells_of(pencils.run_labels(cells, n, connectivity), n).collect()}
    want = brute(mask, connectivity)
    assert got == {(i * n + j) * n + k: want[i, j, k] for i, j, k in map(tuple, np.argwhere(mask))}


def test_runs_are_maximal_and_few_on_a_smooth_field(spark):
    n = 24
    f, df = voxels(spark, n, 3, smooth=True)
    t = float(np.median(f))
    cells = df.where(F.col("dens") < t).select("i", "j", "k").cache()
    got = sorted(tuple(r) for r in pencils.cell_runs(cells).collect())
    want = []
    for i, j in np.ndindex(n, n):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (f[i, j] < t).astype(int), [0]])))
        want += [(i, j, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    assert got == sorted(want)
    # what is joined and contracted: runs and their edges, against cells and their neighbours
    by_cells = cells.count() * 3 + grid.neighbour_pairs(cells, n).count()
    runs_ = pencils.cell_runs(cells)
    assert runs_.count() + pencils.run_edges(runs_, n).count() < 0.2 * by_cells


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=16, unique=True), st.lists(st.integers(0, 40), max_size=16, unique=True), st.integers(0, 1))
def test_overlaps(a, b, reach):
    ends = lambda x: (np.array(sorted(x)[: len(x) // 2 * 2 : 2], np.int64), np.array(sorted(x)[1 : len(x) // 2 * 2 : 2], np.int64))
    (a0, a1), (b0, b1) = ends(a), ends(b)
    x, y = pencils.overlaps(a0, a1, b0, b1, reach)
    want = {(i, j) for i in range(len(a0)) for j in range(len(b0)) if a0[i] - reach < b1[j] and b0[j] < a1[i] + reach}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and len(x) == len(want)


def test_spanning_forest(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 8, 150), strict=True)]
    edges += [(100, 101, 1.0), (101, 100, 0.5), (7, 7, 0.0), (1, 200, None)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if w is not None):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.append((a, b, w))
    got = mergetree.spanning_forest(spark.createDataFrame(edges, "src bigint, dst bigint, weight double"))
    assert sorted(map(tuple, got.select("src", "dst", "weight").collect())) == sorted(want)
    assert mergetree.spanning_forest(spark.createDataFrame([], "src bigint, dst bigint, weight double")).collect() == []


@pytest.mark.parametrize("below", [True, False])
def test_labels_at_every_threshold(spark, below):
    n, levels = 5, [0.9, 0.2, 0.5, 0.35]
    f, df = voxels(spark, n, 9)
    f = np.round(f, 1)  # many equal values
    df = df.withColumn("dens", F.round("dens", 1))
    forest = mergetree.merge_forest(df, n, "dens", below)
    got = {(r["level"], r["cell_id"]): r["root"] for r in mergetree.threshold_labels(df, forest, n, "dens", levels, below).collect()}
    want = {}
    for level, t in enumerate(levels):
        mask = f < t if below else f > t
        roots = brute(mask)
        want |= {(level, (i * n + j) * n + k): roots[i, j, k] for i, j, k in map(tuple, np.argwhere(mask))}
    assert got == want and forest.count() < n**3


def test_sweep_equals_single_runs(spark):
    n = 6
    rng = np.random.default_rng(1)
    rows = [(i, j, k, *map(float, rng.random(5).astype(np.float32) + 0.5)) for i, j, k in np.ndindex(n, n, n)]
    table = spark.createDataFrame(rows, "i int, j int, k int, dens float, etot float, m1 float, m2 float, m3 float")
    one = lambda t, **x: EngineConfig(n=n, cut_by="density", cut_op="gt", threshold=t, dims=(2, 1, 1), **x)
    sweep = runs.run_sweep(spark, table, [one(0.9), one(1.2), one(1.2, step=3)])
    row = lambda r: (r["step"], r["threshold"], r["cell_count"], *(round(r[c], 5) for c in ("volume", "mass", "area", "velocity_mean", "velocity_std", "centroid_mass_y")), r["k_min"], r["k_max"])
    single = [r for c in (one(0.9), one(1.2), one(1.2, step=3)) for r in runs.run_catalog(spark, table, c).collect()]
    assert sorted(map(row, sweep.collect())) == sorted(map(row, single))


@pytest.mark.parametrize(("cells", "size", "start", "centre"), [
    ([0, 1, 7], 3, 7, 0.5), ([3], 1, 3, 3.5), (list(range(8)), 8, 0, 4.0), ([0, 4], 5, 0, 2.5), ([6, 7], 2, 6, 7.0), ([1, 7], 3, 7, 0.5),
])
def test_extent_on_the_ring(spark, cells, size, start, centre):
    table = spark.createDataFrame([(5, x, 0, 2, 1.0) for x in cells], "root bigint, i int, j int, k int, dens double")
    r = periodic.periodic_extents(periodic.occupied_planes(table, "root"), 8, (1.0, 1.0, 0.5), "root").first()
    assert (r["x_size"], r["x_start"]) == (size, start) and r["centroid_vol_x"] == pytest.approx(centre)
    assert (r["y_size"], r["z_size"], r["z_start"]) == (1, 1, 2) and r["centroid_mass_z"] == pytest.approx(1.25)


def test_extents_do_not_depend_on_the_origin(spark):
    """Shifting a structure around the torus shifts its box and centroid, and nothing else."""
    n = 8
    shape = [(0, 0, 0, 1.0), (1, 0, 0, 3.0), (1, 1, 0, 2.0), (1, 1, 1, 5.0)]
    moved = [(s, (i + s) % n, (j + 3 * s) % n, (k + 5 * s) % n, m) for s in range(n) for i, j, k, m in shape]
    table = spark.createDataFrame(moved, "root bigint, i int, j int, k int, dens double")
    rows = periodic.periodic_extents(periodic.occupied_planes(table, "root"), n, (1.0,) * 3, "root").collect()
    mean = [sum(m * (p[a] + 0.5) for *p, m in shape) / 11 for a in range(3)]
    for r in rows:
        s = r["root"]
        for a, x, by in ((0, "x", 1), (1, "y", 3), (2, "z", 5)):
            assert (r[f"{x}_start"], r[f"{x}_size"]) == ((by * s) % n, 2)
            assert r[f"centroid_mass_{x}"] == pytest.approx((mean[a] + by * s) % n)

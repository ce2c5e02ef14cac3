"""Whole runs and the optional snapshot source."""

import json
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_grid import brute
from voxelweave.config import EngineConfig
from voxelweave.operators import catalog as C
from voxelweave.plans import runs
from voxelweave.scratch import Scratch
from voxelweave.sources import openpmd, readers
from voxelweave.sources import parts as part_files
from voxelweave.sources.parts import brick_index, check_planes, current_run, manifest, open_run, read_npz_planes, read_parts


def fields(n=6, seed=4):
    rng = np.random.default_rng(seed)
    return {k: (rng.random((n, n, n)) * 5 + 0.5).astype(np.float32) for k in readers.RECORDS}


def test_run_and_sweep(spark, tmp_path):
    f = fields()
    readers.field_table(spark, **f).write.parquet(str(tmp_path / "v"))
    voxels = readers.read_voxels(spark, str(tmp_path / "v"))
    config = EngineConfig(n=6, cut_by="density", cut_op="gt", threshold=3.2, dims=(2, 2, 1), step=7)
    cat = runs.run_catalog(spark, voxels, config, str(tmp_path / "out"))
    want = np.unique(brute(f["dens"] > np.float32(3.2))[f["dens"] > np.float32(3.2)], return_counts=True)[1]
    assert sorted(r["cell_count"] for r in cat.collect()) == sorted(want)
    s = runs.summaries(cat, 10)
    assert s["spectrum"].agg(F.sum("n")).first()[0] == len(want) and s["correlations"].count() == 36
    none = EngineConfig(n=6, cut_by="density", cut_op="gt", threshold=99.0)
    both = runs.run_sweep(spark, voxels, [config, none])
    assert both.count() == len(want) and runs.summaries(both.limit(0)) == {}


@pytest.mark.parametrize("dims", [(2, 2, 1), (2, 2, 2), (2, 2, 5)])
@pytest.mark.parametrize("periodic", [(True, True, True), (False, True, False)])
def test_stitch_from_parts(spark, tmp_path, dims, periodic):
    """Parts on disk, of either form, give the direct run's catalog; missing and odd parts are noticed."""
    f = fields(6, 11)
    config = EngineConfig(n=6, cut_by="density", cut_op="gt", threshold=3.4, dims=dims, periodic=periodic)
    direct = runs.run_catalog(spark, readers.field_table(spark, **f), config, str(tmp_path / "out"))
    key = lambda df: sorted((r["gid"], r["cell_count"], round(r["area"], 9), round(r["volume"], 9), round(r["mass"], 6)) for r in df.collect())
    merged = runs.run_stitch(spark, str(tmp_path / "out"), str(tmp_path / "merged"))
    assert key(merged) == key(direct) and len(key(direct)) > 5
    assert [r["gid"] for r in runs.run_stitch(spark, str(tmp_path / "out")).collect()] == [r[0] for r in key(direct)]
    if dims == (2, 2, 1) and all(periodic):
        kept = readers.read_part_index(spark, current_run(spark, str(tmp_path / "out")) + "/part_meta")
        with pytest.raises(KeyError, match="no part"):
            brick_index(kept.where("rank <> 3"))
        with pytest.raises(ValueError):
            brick_index(kept.withColumn("cart_dims", F.when(F.col("rank") == 0, F.array(F.lit(4), F.lit(1), F.lit(1))).otherwise(F.col("cart_dims"))))
        odd = kept.withColumn("node_bbox_ijk", F.when(F.col("rank") == 0, F.transform("node_bbox_ijk", lambda x, i: x + (i == 3).cast("bigint"))).otherwise(F.col("node_bbox_ijk")))
        with pytest.raises(ValueError, match="shape"):
            check_planes(odd, brick_index(odd))


def test_a_failed_run_leaves_the_last_one_whole_and_is_resumed(spark, tmp_path, monkeypatch):
    f, out = fields(6, 21), str(tmp_path / "out")
    voxels = readers.field_table(spark, **f)
    config = lambda t: EngineConfig(n=6, cut_by="density", cut_op="gt", threshold=t, dims=(2, 2, 1))
    rows = lambda df: sorted((r["gid"], r["cell_count"], round(r["area"], 9)) for r in df.collect())
    first = rows(runs.run_catalog(spark, voxels, config(3.4), out))
    write = part_files._write

    def fails(df, path, kind):
        if path.endswith("/part_meta"):  # rows and planes are there by then; one brick's metadata goes through
            write(df.where("rank = 2"), path, kind)
            raise OSError("lost")
        write(df, path, kind)

    monkeypatch.setattr(part_files, "_write", fails)
    with pytest.raises(OSError, match="lost"):
        runs.run_catalog(spark, voxels, config(3.0), out)
    monkeypatch.setattr(part_files, "_write", write)
    assert manifest(spark, out).count() == 1 and rows(runs.run_stitch(spark, out)) == first
    again = open_run(spark, out, config(3.0))
    assert [r["rank"] for r in again.done(spark).collect()] == [2]
    with pytest.raises(RuntimeError, match="3 bricks"):
        again.complete(spark)
    stamp = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "out/generations").rglob("rank=2/*") if again.generation in str(p)}
    before = stamp()
    second = rows(runs.run_catalog(spark, voxels, config(3.0), out))
    assert stamp() == before != {}, "a complete brick was written again"
    assert second == rows(runs.run_catalog(spark, voxels, config(3.0))) != first and rows(runs.run_stitch(spark, out)) == second
    _, _, _, meta = read_parts(spark, out)
    got = meta.collect()
    assert len(got) == 4 and {json.loads(r["config"])["threshold"] for r in got} == {3.0} and all(min(r["times"]) > 0 for r in got)
    assert [r["number"] for r in manifest(spark, out).orderBy("number").collect()] == [1, 2]
    with pytest.raises(FileNotFoundError, match="no completed run"):
        current_run(spark, str(tmp_path / "nothing"))


def test_stitch_npz_parts(spark, tmp_path):
    f = fields(6, 12)
    config = EngineConfig(n=6, cut_by="density", cut_op="gt", threshold=3.4, dims=(2, 1, 1))
    direct = runs.run_catalog(spark, readers.field_table(spark, **f), config, str(tmp_path / "out"))
    parts, planes, _, meta = read_parts(spark, str(tmp_path / "out"))
    folder = tmp_path / "npz"
    folder.mkdir()
    p, q = parts.toPandas().sort_values("label_ids"), planes.toPandas()
    for r in meta.collect():
        rank, box = r["rank"], r["node_bbox_ijk"]
        size = {a: box[2 * i + 1] - box[2 * i] for i, a in enumerate("xyz")}
        m = p[p["rank"] == rank]
        out = {n: m[n].to_numpy() for n in ("label_ids", "cell_count", "volume", "mass", "area", "velocity_mean", "velocity_std")} | {"rank": np.int32(rank)}
        out |= {f"centroid_{k}": m[[f"centroid_{k}_{a}" for a in "xyz"]].to_numpy() for k in ("vol", "mass")} | {"bbox_ijk": m[[f"{a}_{s}" for a in "ijk" for s in ("min", "max")]].to_numpy()}
        for axis in "xyz":
            for side in ("neg", "pos"):
                plane = np.zeros([size[b] for b in "xyz" if b != axis], np.uint32)
                mine = q[(q["rank"] == rank) & (q["axis"] == axis) & (q["side"] == side)]
                plane[mine["u"], mine["v"]] = mine["local_id"]
                out |= {f"face_{axis}{side}": plane, f"ovlp_{axis}{side}": plane}
        np.savez(folder / f"clumps_rank{rank:05d}.npz", **out)
        doc = {"rank": rank, "coords": r["coords"], "cart_dims": r["cart_dims"], "node_bbox_ijk": box, "output_npz": f"clumps_rank{rank:05d}.npz", "grid": {"periodic": [True] * 3, "Nres": 6, "dx": 1 / 6, "dy": 1 / 6, "dz": 1 / 6}}
        (folder / f"clumps_rank{rank:05d}.meta.json").write_text(json.dumps(doc, indent=2))
    key = lambda df: sorted((r["gid"], r["cell_count"], round(r["area"], 9), round(r["centroid_mass_y"], 9), r["k_max"]) for r in df.collect())
    assert key(runs.run_stitch(spark, str(folder))) == key(direct)
    faces, overlaps = (read_npz_planes(spark, str(folder), kind).collect() for kind in ("face", "ovlp"))
    assert sorted(faces) == sorted(overlaps) and len(faces) > 20


def test_directory_and_feature_outputs(spark, tmp_path):
    f = fields(6, 13)
    config = EngineConfig(n=6, cut_by="density", cut_op="gt", threshold=3.9, dims=(2, 1, 1), step=31)
    cat = runs.run_catalog(spark, readers.field_table(spark, **f), config)
    cat.write.parquet(str(tmp_path / "n6_sweep/step00031/clumps_stitched"))
    done = runs.run_directory(spark, str(tmp_path / "n6_sweep"), str(tmp_path / "sum"), 8)
    assert done == [str(tmp_path / "sum") + "/step00031"] and spark.read.parquet(done[0] + "/correlations").count() == 36
    runs.feature_outputs(cat.withColumn("velocity_std", F.col("volume") * 2), ["volume", "mass", "area"], str(tmp_path / "features"), 2)
    n = cat.count()
    assert spark.read.parquet(str(tmp_path / "features/pca_scores")).count() == n == spark.read.parquet(str(tmp_path / "features/embedding")).count()
    assert spark.read.parquet(str(tmp_path / "features/pca_components")).count() == 6


def test_suffixed_records(spark, tmp_path):
    f = {readers.RECORDS[k].format("lvl0"): v for k, v in fields(3).items()}
    readers.field_table(spark, **f).withColumn("step", F.lit(2)).write.parquet(str(tmp_path / "v"))
    df = readers.read_voxels(spark, str(tmp_path / "v"), 2)
    assert {"dens", "etot", "m3"} <= set(df.columns) and df.count() == 27
    assert readers.read_voxels(spark, str(tmp_path / "v"), 3).count() == 0


def test_snapshot_reader(monkeypatch):
    f = fields(4)

    class Component:
        def __init__(self, a):
            self.a = a.transpose(2, 1, 0)  # stored z, y, x
            self.shape = self.a.shape

        def load_chunk(self, at, size):
            return self.a[tuple(slice(o, o + s) for o, s in zip(at, size, strict=True))]

    meshes = {readers.RECORDS[k].format("lvl1"): {"scalar": Component(v)} for k, v in f.items()}
    series = types.SimpleNamespace(iterations={3: types.SimpleNamespace(meshes=meshes)}, flush=lambda: None)
    monkeypatch.setitem(sys.modules, "openpmd_api", types.SimpleNamespace(Series=lambda *_: series, Access=types.SimpleNamespace(read_only=0)))
    r = openpmd.OpenPMDSource({"path": "x", "step": "3", "dims": "2,1,1"}).reader(None)
    parts = r.partitions()
    assert len(parts) == 2 and openpmd.OpenPMDSource.name() == "openpmd"
    seen = 0
    for p in parts:
        for b in r.read(p):
            for row in b.to_pylist():
                assert row["m2"] == pytest.approx(float(f["m2"][row["i"], row["j"], row["k"]]))
                seen += 1
    assert seen == 64


def _parts_columns(spark):
    f = fields(6, 11)
    config = EngineConfig(n=6, cut_by="density", cut_op="gt", threshold=3.4, dims=(2, 2, 1))
    full, _ = runs.labelled_cells(readers.field_table(spark, **f), config, Scratch(spark, "columns"))
    return dict(C.unstitched_catalog(full, 6, (2, 2, 1), config.spacing).dtypes)


def test_a_run_without_structures(spark, tmp_path):
    """No cell passes the cut: the parts have metadata but no file of rows, and everything read from them is empty."""
    out = str(tmp_path / "out")
    config = EngineConfig(n=6, cut_by="density", cut_op="gt", threshold=99.0, dims=(2, 2, 1))
    assert runs.run_catalog(spark, readers.field_table(spark, **fields(6, 11)), config, out).count() == 0
    parts, planes, bricks, meta = read_parts(spark, out)
    assert parts.count() == planes.count() == 0 and bricks.count() == 4 and [r["K"] for r in meta.collect()] == [0] * 4
    assert runs.run_stitch(spark, out).count() == 0
    assert dict(parts.dtypes) == _parts_columns(spark)


@pytest.mark.parametrize("name, rows", [("part_metadata", 8), ("stitch_from_parts", 0), ("stitch_from_parts_open", 0), ("stitched_equals_direct", 1)])
def test_part_queries_where_no_cell_passes(spark, tmp_path, name, rows):
    """One row a cell whose discount is above the threshold everywhere: the mask is empty, as on tables of many rows a cell."""
    spark.range(64).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1D AS l_quantity", "0.09D AS l_discount", "0.01D AS l_tax", "1 AS l_linenumber", "'R' AS l_returnflag", "10D AS l_extendedprice"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == rows
    if name == "stitched_equals_direct":
        assert got[0].asDict() == {"differences": 0, "clumps": 0, "cells": 0}
    if name == "part_metadata":
        assert {r["structures"] for r in got} == {0}

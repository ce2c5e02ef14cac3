"""Parts of a run, one a brick: catalog, boundary planes and metadata; written, read back, and checked."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.config import EngineConfig
from voxelweave.operators import grid
from voxelweave.scratch import Scratch, path_exists
from voxelweave.sources.readers import META, read_part_index
from voxelweave.sources.sinks import git_revision

PLANES = "rank int, axis string, side string, u int, v int, local_id bigint"
_CENTRES = [f"centroid_{k}_{a}" for k in ("vol", "mass") for a in "xyz"]
_BOXES = [f"{a}_{s}" for a in "ijk" for s in ("min", "max")]
#: Columns of ``catalog.unstitched_catalog``, given to the reader since a run without any structure has no file.
PARTS = ", ".join(["gid bigint", "label_ids int", "cell_count bigint", *(f"{c} double" for c in ("volume", "mass", *_CENTRES, "velocity_mean", "velocity_std")), *(f"{c} bigint" for c in _BOXES), "num_cells bigint", "area double", "rank int"])
#: Names of the arrays of a part file.
SCALARS = ("label_ids", "cell_count", "num_cells", "volume", "mass", "area", "velocity_mean", "velocity_std")


MANIFEST = "number int, generation string, config string, written timestamp"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The runs that were completed under ``path``, one row each; the one of the greatest ``number`` is current."""
    where = f"{path}/manifest"
    return spark.read.schema(MANIFEST).json(where) if path_exists(spark, where) else spark.createDataFrame([], MANIFEST)


def current_run(spark: SparkSession, path: str) -> str:
    """Folder of the last completed run under ``path``; FileNotFoundError if there is none."""
    last = manifest(spark, path).agg(F.max_by("generation", "number")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no completed run under {path}")
    return f"{path}/generations/{last}"


@dataclass(frozen=True)
class PartRun:
    """A run that is being written: a folder of its own, of which nothing is read before it is complete.

    A brick is done when its metadata is there, which is written after its rows and planes. ``open_run`` finds what an
    earlier attempt at the same settings has left, so that only missing bricks are written; a brick that is written again
    replaces what a failed attempt left of it (partitions by ``rank``, overwritten one by one).
    """

    path: str
    number: int
    generation: str
    config: EngineConfig

    @property
    def folder(self) -> str:
        return f"{self.path}/generations/{self.generation}"

    def done(self, spark: SparkSession) -> DataFrame:
        """``rank`` of the bricks that are complete."""
        where = f"{self.folder}/part_meta"
        return spark.read.schema(META).json(where).select("rank") if path_exists(spark, where) else spark.createDataFrame([], "rank int")

    def write(self, parts: DataFrame, planes: DataFrame, times: dict[str, float] | None = None) -> None:
        """Catalog rows, planes and metadata of the bricks that are missing. ``times`` are seconds of the run's steps."""
        spark, config = parts.sparkSession, self.config
        done = F.broadcast(self.done(spark))  # one row a brick
        todo = Scratch(spark, "todo").keep(grid.brick_table(spark, config.n, config.dims, config.periodic).join(done, "rank", "left_anti"), "bricks")
        own = lambda df: df.join(F.broadcast(todo.select("rank")), "rank", "left_semi")
        _write(own(parts), f"{self.folder}/parts", "parquet")
        _write(own(planes), f"{self.folder}/planes", "parquet")
        count = spark.read.schema(parts.schema).parquet(f"{self.folder}/parts").groupBy("rank").agg(F.count("*").alias("K"))
        _write(self._metadata(todo.join(count, "rank", "left"), times or {}), f"{self.folder}/part_meta", "json")

    def _metadata(self, bricks: DataFrame, times: dict[str, float]) -> DataFrame:
        config = self.config
        flags = lambda values: F.array(*(F.lit(v) for v in values))
        return bricks.select(
            "rank", F.array("ci", "cj", "ck").alias("coords"), flags(config.dims).alias("cart_dims"), F.array(*(F.col(c).cast("bigint") for c in ("i0", "i1", "j0", "j1", "k0", "k1"))).alias("node_bbox_ijk"),
            F.coalesce("K", F.lit(0)).alias("K"), F.lit("parts").alias("output_npz"),
            F.struct(F.lit(config.n).alias("Nres"), *(F.lit(float(v)).alias(f"d{a}") for v, a in zip(config.spacing, "xyz", strict=True)), flags([float(v) for v in config.origin]).alias("origin"), flags(config.periodic).alias("periodic")).alias("grid"),
            F.struct(F.lit(config.connectivity).alias("connectivity"), F.lit(config.cut_by).alias("cut_by"), F.lit(config.cut_op).alias("cut_op"), F.lit(float(config.threshold)).alias("threshold"), F.lit(config.ghost_width).alias("ghost_width")).alias("labeling"),
            F.struct(F.lit(config.overlap_width).alias("overlap_width"), F.lit(config.min_clump_cells).alias("min_clump_cells_deferred")).alias("stitching"),
            F.struct(F.lit(config.step).alias("step")).alias("dataset"),
            F.struct(*(F.lit(float(times.get(k, 0.0))).alias(k) for k in ("load", "label", "reduce"))).alias("times"), F.lit(git_revision()).alias("git_rev"), F.lit(_snapshot(config)).alias("config"),
        )

    def complete(self, spark: SparkSession) -> None:
        """Make this run the current one: one row more in the manifest. RuntimeError if a brick is missing."""
        missing = grid.brick_table(spark, self.config.n, self.config.dims, self.config.periodic).join(self.done(spark), "rank", "left_anti").count()
        if missing:
            raise RuntimeError(f"{missing} bricks of the run are missing")
        row = spark.range(1).select(F.lit(self.number).alias("number"), F.lit(self.generation).alias("generation"), F.lit(_snapshot(self.config)).alias("config"), F.current_timestamp().alias("written"))
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifest")


def _snapshot(config: EngineConfig) -> str:
    return json.dumps(asdict(config), sort_keys=True)


def _write(df: DataFrame, path: str, kind: str) -> None:
    df.repartition("rank").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rank").format(kind).save(path)


def open_run(spark: SparkSession, path: str, config: EngineConfig) -> PartRun:
    """The run to write next under ``path``: a fresh one, or an attempt at the same settings that was not completed (which
    must have been over the same voxels)."""
    last = manifest(spark, path).agg(F.max("number")).first()[0] or 0
    digest = hashlib.sha256(_snapshot(config).encode()).hexdigest()[:16]
    return PartRun(path, last + 1, f"{last + 1:06d}-{digest}", config)


def write_parts(parts: DataFrame, planes: DataFrame, path: str, config: EngineConfig, times: dict[str, float] | None = None) -> None:
    """Write catalog rows and planes of all bricks as the current run under ``path``: ``generations/ID/parts``, ``planes`` and
    ``part_meta`` (JSON, by rank, also where a brick has no structure), then a row of ``manifest``."""
    run = open_run(parts.sparkSession, path, config)
    run.write(parts, planes, times)
    run.complete(parts.sparkSession)


def brick_index(meta: DataFrame) -> DataFrame:
    """``rank, ci, cj, ck`` and ``next_x, next_y, next_z`` of a run's metadata (``read_part_index``).

    KeyError if a brick that some brick borders on has no metadata; ValueError if parts disagree about the
    split or the periodic axes, or two claim one place.
    """
    spark = meta.sparkSession
    rows = meta.select("rank", "coords", "cart_dims", F.col("grid.periodic").alias("periodic")).collect()  # one small row a brick
    splits = {(tuple(r["cart_dims"]), tuple(r["periodic"] or (True,) * 3)) for r in rows}
    if len(splits) != 1 or len({tuple(r["coords"]) for r in rows}) != len(rows):
        raise ValueError("parts disagree about the split, or two of them claim one place")
    (dims, periodic), at = next(iter(splits)), {tuple(r["coords"]): r["rank"] for r in rows}
    out, missing = [], set()
    for r in rows:
        after: list[int | None] = []
        for axis in range(3):
            c = list(r["coords"])
            c[axis] += 1
            if c[axis] == dims[axis]:
                c[axis] = 0 if periodic[axis] else -1
            if c[axis] >= 0 and tuple(c) not in at:
                missing.add(tuple(c))
            after.append(at.get(tuple(c)))
        out.append((r["rank"], *r["coords"], *after))
    if missing:
        raise KeyError(f"no part for the bricks at {sorted(missing)}")
    return spark.createDataFrame(out, "rank int, ci int, cj int, ck int, next_x int, next_y int, next_z int")


def check_planes(meta: DataFrame, bricks: DataFrame) -> None:
    """ValueError if two neighbouring bricks have planes of different shape."""
    box = F.col("node_bbox_ijk")
    size = meta.select("rank", *((box[2 * i + 1] - box[2 * i]).alias(f"n{a}") for i, a in enumerate("xyz")))
    for axis in "xyz":
        others = [b for b in "xyz" if b != axis]
        near = size.select(F.col("rank").alias(f"next_{axis}"), *(F.col(f"n{b}").alias(f"m{b}") for b in others))
        bad = bricks.select("rank", f"next_{axis}").join(size, "rank").join(near, f"next_{axis}").where(" OR ".join(f"n{b} <> m{b}" for b in others))
        if not bad.isEmpty():
            raise ValueError(f"planes of neighbours on axis {axis} differ in shape")


def read_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Catalog rows, planes, bricks (``brick_index``) and metadata of the current run under ``path``, checked."""
    where = current_run(spark, path)
    meta = read_part_index(spark, f"{where}/part_meta")
    bricks = brick_index(meta)
    check_planes(meta, bricks)
    return spark.read.schema(PARTS).parquet(f"{where}/parts"), spark.read.schema(PLANES).parquet(f"{where}/planes"), bricks, meta


def _npz_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")


def read_npz_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of part files in NPZ form, with ``rank`` and ``gid``."""
    cents, boxes = _CENTRES, _BOXES
    names = ["rank", *SCALARS, *cents, *boxes, "gid"]
    kinds = {"rank": "int", "label_ids": "int", "gid": "bigint", **dict.fromkeys(("cell_count", "num_cells", *boxes), "bigint")}

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for content in t["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    out = {n: z[n] if n in z else z["cell_count"] for n in SCALARS}
                    for k in ("vol", "mass"):
                        out |= {f"centroid_{k}_{a}": z[f"centroid_{k}"][:, i] for i, a in enumerate("xyz")}
                    out |= {name: z["bbox_ijk"][:, i] for i, name in enumerate(boxes)}
                    frame = pd.DataFrame(out).assign(rank=int(z["rank"]))
                    yield frame.assign(gid=frame["rank"].astype("int64") * (1 << 32) + frame["label_ids"].astype("int64"))[names]

    return _npz_files(spark, path).mapInPandas(run, ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))


def read_npz_planes(spark: SparkSession, path: str, kind: str = "face") -> DataFrame:
    """``rank, axis, side, u, v, local_id`` of the ``face`` or ``ovlp`` planes of part files; a KeyError for parts without."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for name, content in zip(t["path"], t["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for axis in "xyz":
                        for side in ("neg", "pos"):
                            if f"{kind}_{axis}{side}" not in z:
                                raise KeyError(f"no {kind}_{axis}{side} in {name}")
                            plane = z[f"{kind}_{axis}{side}"]
                            u, v = np.nonzero(plane)
                            yield pd.DataFrame({"rank": int(z["rank"]), "axis": axis, "side": side, "u": u.astype(np.int32), "v": v.astype(np.int32), "local_id": plane[u, v].astype(np.int64)})

    return _npz_files(spark, path).mapInPandas(run, PLANES)

"""Component labels of foreground cells: global, by brick, with halo, and stitched."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.components import connected_components
from voxelweave.operators.grid import TORUS, Axes, brick_table, cell_id, face_pairs, gid, neighbour_pairs, offsets, split_axis, with_brick, with_halo
from voxelweave.operators.ranks import numbered
from voxelweave.scratch import Scratch


def label_points(at: np.ndarray, connectivity: int = 6) -> np.ndarray:
    """Component number (the smallest row in it) of sparse lattice points, one row each, no wrap."""
    if not len(at):
        return np.zeros(0, np.int64)
    low = at.min(0) - 1
    span = at.max(0) - low + 2
    flat = lambda p: ((p[:, 0] - low[0]) * span[1] + (p[:, 1] - low[1])) * span[2] + (p[:, 2] - low[2])
    ids = flat(at)
    order = np.argsort(ids)
    ordered = ids[order]
    pairs = []
    for o in offsets(connectivity):
        want = flat(at + np.array(o))
        pos = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
        hit = np.flatnonzero(ordered[pos] == want)
        pairs.append(np.stack([hit, order[pos[hit]]]))
    a, b = np.concatenate(pairs, 1)
    root = np.arange(len(at))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root[root] == root).all():
            root = root[root]


def global_labels(cells: DataFrame, n: int, connectivity: int = 6) -> DataFrame:
    """``cell_id, root``: components on the periodic grid; the root is the smallest cell id."""
    pairs = neighbour_pairs(cells, n, connectivity).select("src", "dst")
    return connected_components(pairs, cells.select(cell_id(n).alias("id"))).withColumnRenamed("id", "cell_id")


def snapshot_labels(cells: DataFrame, n: int, snapshot: str, connectivity: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """``snapshot, cell_id, root`` of several snapshots' cells at once: one contraction for all of them.

    ``snapshot`` is an integer column, 0 or more, below 2**63 / n**3.
    """
    whole = lambda c: F.col(snapshot).cast("bigint") * n**3 + F.col(c)
    pairs = neighbour_pairs(cells, n, connectivity, by=(snapshot,)).select(whole("src").alias("src"), whole("dst").alias("dst"))
    roots = connected_components(pairs, cells.withColumn("cell_", cell_id(n)).select(whole("cell_").alias("id")), scratch)
    kind = cells.schema[snapshot].dataType.simpleString()
    return roots.select(F.expr(f"CAST(id DIV {n**3} AS {kind})").alias(snapshot), F.expr(f"id % {n**3}").alias("cell_id"), F.expr(f"root % {n**3}").alias("root"))


def brick_labels(cells: DataFrame, n: int, dims: tuple[int, int, int], connectivity: int = 6, halo: int = 0) -> DataFrame:
    """``rank, cell_id, i, j, k, label_ids``: labels inside each brick, dense from 1 by smallest cell id.

    With ``halo``, cells also connect through the halo, but only core cells are labelled. One brick is one
    group; its foreground has to fit a worker.
    """
    spark = cells.sparkSession
    cells = cells.select(*(F.col(a).cast("int").alias(a) for a in "ijk"))
    if halo:
        rows = with_halo(cells, n, dims, brick_table(spark, n, dims), halo)
    else:
        rows = with_brick(cells, n, dims).select("*", F.col("i").alias("gi"), F.col("j").alias("gj"), F.col("k").alias("gk"), F.lit(True).alias("core"))
    rows = rows.select("rank", "i", "j", "k", *(F.col(a).cast("int").alias(a) for a in ("gi", "gj", "gk")), "core", cell_id(n))

    def run(t: pa.Table) -> pa.Table:
        at = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("gi", "gj", "gk")], 1)
        core = t.column("core").to_numpy()
        root, cid = label_points(at, connectivity), t.column("cell_id").to_numpy()
        # dense numbers by the smallest core cell of each component
        names, where = np.unique(root[core], return_inverse=True)
        first = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(first, where, cid[core])
        label = np.empty(len(names), np.int64)
        label[np.argsort(first)] = np.arange(1, len(names) + 1)
        out = t.filter(pa.array(core)).select(["rank", "cell_id", "i", "j", "k"])
        return out.append_column("label_ids", pa.array(label[where], pa.int32()))

    return rows.groupBy("rank").applyInArrow(run, "rank int, cell_id bigint, i int, j int, k int, label_ids int")


def interface_edges(labelled: DataFrame, n: int, dims: tuple[int, int, int], periodic: Axes = TORUS) -> DataFrame:
    """``lo, hi, axis, cnt``: pairs of local components that touch over a brick face (rims of periodic axes included)."""
    own = labelled.withColumn("gid", gid())
    last = [F.col(a).isin([hi - 1 for hi in his]) for a, his in zip("ijk", _ends(n, dims), strict=True)]
    first = [F.col(a).isin([lo for lo in los]) for a, los in zip("ijk", _ends(n, dims, first=True), strict=True)]
    rim = own.where(last[0] | last[1] | last[2] | first[0] | first[1] | first[2])
    pairs = face_pairs(rim, n, ("gid", "i", "j", "k"), periodic)
    over = F.lit(False)
    for axis, a, his in zip("xyz", "ijk", _ends(n, dims), strict=True):
        over = over | ((F.col("axis") == axis) & F.col(f"src_{a}").isin([hi - 1 for hi in his]))
    return pairs.where(over).groupBy(F.least("src_gid", "dst_gid").alias("lo"), F.greatest("src_gid", "dst_gid").alias("hi"), "axis").agg(F.count("*").alias("cnt"))


def face_planes(labelled: DataFrame, bricks: DataFrame) -> DataFrame:
    """``rank, axis, side, u, v, local_id``: foreground pixels of the six outermost planes of each brick, with brick
    coordinates on the two other axes. They are also the planes that two bricks with an overlap of one cell share."""
    at = labelled.join(F.broadcast(bricks.select("rank", "i0", "i1", "j0", "j1", "k0", "k1")), "rank")
    sides = []
    for axis, a in zip("xyz", "ijk", strict=True):
        u, v = ((F.col(b) - F.col(f"{b}0")).cast("int") for b in "ijk" if b != a)
        for side, on in (("neg", F.col(a) == F.col(f"{a}0")), ("pos", F.col(a) == F.col(f"{a}1") - 1)):
            sides.append(F.when(on, F.struct(F.lit(axis).alias("axis"), F.lit(side).alias("side"), u.alias("u"), v.alias("v"))))
    rows = at.select("rank", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("p"), F.col("label_ids").alias("local_id"))
    return rows.select("rank", "p.axis", "p.side", "p.u", "p.v", "local_id")


def plane_edges(planes: DataFrame, bricks: DataFrame) -> DataFrame:
    """``lo, hi, axis, cnt`` from the planes of bricks: each positive plane meets the negative one of the next brick
    (``next_x``, ``next_y``, ``next_z``; null: none) pixel by pixel."""
    after = bricks.select(F.col("rank").alias("r_"), F.inline(F.array(*(F.struct(F.lit(a).alias("a_"), F.col(f"next_{a}").alias("next")) for a in "xyz")))).where("next IS NOT NULL")
    pos = planes.where("side = 'pos'").join(F.broadcast(after), (F.col("rank") == F.col("r_")) & (F.col("axis") == F.col("a_")))
    pos = pos.select("axis", "u", "v", F.col("next").alias("rank"), gid("rank", "local_id").alias("a"))
    neg = planes.where("side = 'neg'").select("axis", "u", "v", "rank", gid("rank", "local_id").alias("b"))
    return pos.join(neg, ["rank", "axis", "u", "v"]).groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "axis").agg(F.count("*").alias("cnt"))


def _ends(n: int, dims: tuple[int, int, int], first: bool = False) -> list[list[int]]:
    return [[r[0] if first else r[1] for r in split_axis(n, p)] for p in dims]


def stitched_roots(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """``gid, root``: local components joined over faces; the root is the smallest gid."""
    vertices = labelled.select(gid().alias("id")).distinct()
    return connected_components(edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst")), vertices).withColumnRenamed("id", "gid")


def brick_path_labels(cells: DataFrame, n: int, dims: tuple[int, int, int], connectivity: int = 6) -> DataFrame:
    """``cell_id, root`` as ``global_labels`` gives, by labelling bricks and joining over faces only.

    The scalable path for face connectivity: cells meet once, by brick; what iterates is the graph of local
    components that touch brick faces.
    """
    if connectivity != 6:
        raise NotImplementedError("bricks are stitched over faces only")
    scratch = Scratch(cells.sparkSession, "bricks")
    local = scratch.keep(brick_labels(cells, n, dims), "local")
    roots = stitched_roots(local, interface_edges(local, n, dims))
    named = local.withColumn("gid", gid()).join(roots, "gid")
    least = named.groupBy("root").agg(F.min("cell_id").alias("least"))
    return named.join(least, "root").select("cell_id", F.col("least").alias("root"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """Replace roots by dense numbers 1..K in ascending order of root (K rows are sorted, by ranges)."""
    return labels.join(numbered(labels.select("root").distinct(), "root", "label"), "root").select("cell_id", "label")

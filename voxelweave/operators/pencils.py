"""Labels by run-length encoding: foreground as runs of cells along ``k``, joined where runs of neighbouring pencils overlap.

A pencil is a column of cells with one ``(i, j)``. Cells become runs where they are read, before anything is shuffled;
runs that touch are merged by pencil; edges are found by one sweep over the sorted runs of two neighbouring pencils. So
what is shuffled, and what the components operator works on, is runs: on a smooth field a small share of the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelweave.operators.components import connected_components
from voxelweave.scratch import Scratch


def pencil_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """``(di, dj, reach)``: half of the neighbouring pencils, and by how many cells along ``k`` runs of the two may miss
    each other and still touch."""
    faces, edges = [(1, 0), (0, 1)], [(1, 1), (1, -1)]
    reach = {6: (0, None), 18: (1, 0), 26: (1, 1)}.get(connectivity)
    if reach is None:
        raise ValueError("connectivity must be 6, 18 or 26")
    return [(*o, reach[0]) for o in faces] + [(*o, reach[1]) for o in edges if reach[1] is not None]


def cell_runs(cells: DataFrame) -> DataFrame:
    """``i, j, k0, k1``: maximal runs of cells (half-open, not over the rim). Repeated cells count once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
            if not len(at):
                continue
            at = at[np.lexsort(at.T[::-1])]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:, :2] != at[:-1, :2]).any(1) | (at[1:, 2] > at[:-1, 2] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            cols = [at[first, 0], at[first, 1], at[first, 2], at[last, 2] + 1]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols], names=["i", "j", "k0", "k1"])

    parts = cells.select(*(F.col(a).cast("int").alias(a) for a in "ijk")).mapInArrow(partial, "i int, j int, k0 int, k1 int")
    # a pencil's partial runs, in order: one that begins behind all before it begins a run
    w = W.partitionBy("i", "j").orderBy("k0", "k1")
    far = F.max("k1").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = parts.withColumn("new_", F.coalesce((F.col("k0") > far).cast("int"), F.lit(1)))
    island = F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.withColumn("island_", island).groupBy("i", "j", "island_").agg(F.min("k0").alias("k0"), F.max("k1").alias("k1")).drop("island_")


def overlaps(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(a, b)`` of intervals with ``a0 - reach < b1`` and ``b0 < a1 + reach``; each side sorted and without
    overlaps, so one search an end finds the range of partners."""
    lo = np.searchsorted(b1, a0 - reach, "right")
    hi = np.searchsorted(b0, a1 + reach, "left")
    many = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(a0)), many)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)


def run_edges(runs: DataFrame, n: int, connectivity: int = 6) -> DataFrame:
    """``src, dst``: runs (each by the id of its first cell) that touch on the periodic grid."""
    moves = pencil_offsets(connectivity)
    pencils = runs.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("k0", "k1"))).alias("r"))  # n / 2 runs at most
    move = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("reach")) for a, b, c in moves)))
    left = pencils.select("i", "j", F.col("r.k0").alias("a0"), F.col("r.k1").alias("a1"), move.alias("m"))
    left = left.select((F.col("i").cast("bigint") * n + F.col("j")).alias("a"), "a0", "a1", F.pmod(F.col("i") + F.col("m.di"), F.lit(n)).alias("i"), F.pmod(F.col("j") + F.col("m.dj"), F.lit(n)).alias("j"), F.col("m.reach").alias("reach"))
    pairs = left.join(pencils.select("i", "j", F.col("r.k0").alias("b0"), F.col("r.k1").alias("b1")), ["i", "j"])
    pairs = pairs.select("a", (F.col("i").cast("bigint") * n + F.col("j")).alias("b"), "a0", "a1", "b0", "b1", "reach")
    # the two ends of a pencil touch each other
    ends = pencils.where((F.col("r")[0]["k0"] == 0) & (F.element_at("r", -1)["k1"] == n) & (F.size("r") > 1))
    base = F.col("i").cast("bigint") * n + F.col("j")
    rim = ends.select((base * n + F.element_at("r", -1)["k0"]).alias("src"), (base * n).alias("dst"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = t.column(0).to_numpy(), t.column(1).to_numpy()
            lists = [t.column(c) for c in (2, 3, 4, 5)]
            a0, a1, b0, b1 = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            reach = t.column(6).to_numpy()
            own_a = np.repeat(np.arange(len(a)), lists[0].value_lengths().to_numpy())
            own_b = np.repeat(np.arange(len(a)), lists[2].value_lengths().to_numpy())
            src, dst = [], []
            for r in np.unique(reach):
                x, y = np.flatnonzero(reach[own_a] == r), np.flatnonzero(reach[own_b] == r)
                # images over the rim only matter where runs may miss each other; they keep their order in a wide frame
                wide = 4 * n
                for turn in (-1, 0, 1) if r else (0,):
                    i, j = overlaps(a0[x] + own_a[x] * wide, a1[x] + own_a[x] * wide, b0[y] + own_b[y] * wide + turn * n, b1[y] + own_b[y] * wide + turn * n, int(r))
                    keep = own_a[x[i]] == own_b[y[j]]
                    src.append(a[own_a[x[i[keep]]]] * n + a0[x[i[keep]]])
                    dst.append(b[own_b[y[j[keep]]]] * n + b0[y[j[keep]]])
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (src, dst)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["src", "dst"])

    return pairs.mapInArrow(sweep, "src bigint, dst bigint").unionByName(rim)


def run_labels(cells: DataFrame, n: int, connectivity: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """``i, j, k0, k1, root``: runs of the foreground with their component, named by its smallest cell id."""
    scratch = scratch or Scratch(cells.sparkSession, "pencils")
    runs = scratch.keep(cell_runs(cells), "runs")
    first = ((F.col("i").cast("bigint") * n + F.col("j")) * n + F.col("k0")).alias("id")
    roots = connected_components(run_edges(runs, n, connectivity), runs.select(first), scratch)
    return runs.withColumn("id", first).join(roots, "id").select("i", "j", "k0", "k1", "root")


def cells_of(runs: DataFrame, n: int) -> DataFrame:
    """``cell_id, root`` of every cell of labelled runs."""
    k = F.explode(F.sequence(F.col("k0"), F.col("k1") - 1))
    return runs.select("i", "j", k.alias("k"), "root").select(((F.col("i").cast("bigint") * n + F.col("j")) * n + F.col("k")).alias("cell_id"), "root")

"""Components at every threshold from one contraction: a minimum spanning forest of the cells in order of a field.

An edge between neighbouring cells exists at a threshold if both ends are beyond it, so it appears at the later of the two
values. The minimum spanning forest under that weight joins, at every threshold, just the cells that all edges join, with
less than one edge a cell. It is found by Boruvka's rounds: every component takes its least outgoing edge, components
contract along them, edges inside a component go; the rounds are logarithmic in the number of cells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.components import connected_components
from voxelweave.operators.grid import cell_id, neighbour_pairs
from voxelweave.scratch import Scratch


def spanning_forest(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 100) -> DataFrame:
    """``src, dst, weight``: the minimum spanning forest of an edge table of these columns (bigint ends).

    Equal weights are ordered by the ends, so the forest is one. Loops, repeated edges and edges with a null are
    tolerated; an empty table gives an empty table. Each round is one algebraic minimum a component and two joins on its
    id; a component with most edges is combined on the map side.
    """
    scratch = scratch or Scratch(edges.sparkSession, "forest")
    run = uuid.uuid4().hex[:6]
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    clean = edges.where("src <> dst AND weight IS NOT NULL").select(lo.alias("src"), hi.alias("dst"), "weight")
    # a, b: components of the ends
    work = scratch.keep(clean.groupBy("src", "dst").agg(F.min("weight").alias("weight")).select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "weight"), f"{run}_work_0")
    taken = None
    for r in range(1, max_rounds + 1):
        if work.isEmpty():
            break
        out = work.select(F.explode(F.array("a", "b")).alias("c"), F.struct("weight", "src", "dst", "a", "b").alias("e"))
        least = scratch.keep(out.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), f"{run}_least_{r}")
        chosen = least.select("src", "dst", "weight")
        taken = chosen if taken is None else taken.unionByName(chosen)
        # chosen edges form a forest over components (ties are ordered): contract it
        roots = scratch.keep(connected_components(least.select(F.col("a").alias("src"), F.col("b").alias("dst")), None, scratch), f"{run}_roots_{r}")
        to = lambda c, roots=roots: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        moved = work.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"), "src", "dst", "weight")
        # of parallel edges the least is enough
        best = moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("weight", "src", "dst")).alias("e"))
        work = scratch.keep(best.select("a", "b", "e.src", "e.dst", "e.weight"), f"{run}_work_{r}")
        scratch.drop(f"{run}_work_{r - 1}")
    else:
        raise RuntimeError(f"the forest was not complete after {max_rounds} rounds")
    return taken if taken is not None else clean.limit(0)


def merge_forest(cells: DataFrame, n: int, field: str, below: bool = True, connectivity: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """``src, dst, weight``: forest of the cells (``i, j, k``, ``field``) on the periodic grid. With ``below``, a cell is
    foreground at a threshold above its value and an edge's weight is the greater value; else weights are negated values."""
    sign = 1.0 if below else -1.0
    value = (F.col(field).cast("double") * sign).alias("v_")
    own = cells.select(cell_id(n), value)
    pairs = neighbour_pairs(cells, n, connectivity).select("src", "dst")
    ends = pairs.join(own.select(F.col("cell_id").alias("src"), F.col("v_").alias("v_src")), "src").join(own.select(F.col("cell_id").alias("dst"), F.col("v_").alias("v_dst")), "dst")
    return spanning_forest(ends.select("src", "dst", F.greatest("v_src", "v_dst").alias("weight")), scratch)


def threshold_labels(cells: DataFrame, forest: DataFrame, n: int, field: str, thresholds: list[float], below: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """``level`` (number of the threshold), ``cell_id, root`` for all thresholds at once: the cells strictly beyond each and
    their components, named by the smallest cell id. All levels are contracted together, along the forest's edges only."""
    sign = 1.0 if below else -1.0
    levels = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(float(t) * sign).alias("t")) for i, t in enumerate(thresholds)))
    at = lambda df, v: df.withColumn("l", F.explode(levels)).where(F.col(v) < F.col("l.t"))
    whole = lambda c: F.col("l.level").cast("bigint") * n**3 + F.col(c)
    vertices = at(cells.select(cell_id(n), (F.col(field).cast("double") * sign).alias("v_")), "v_").select(whole("cell_id").alias("id"))
    edges = at(forest, "weight").select(whole("src").alias("src"), whole("dst").alias("dst"))
    roots = connected_components(edges, vertices, scratch)
    return roots.select(F.expr(f"CAST(id DIV {n**3} AS INT)").alias("level"), F.expr(f"id % {n**3}").alias("cell_id"), F.expr(f"root % {n**3}").alias("root"))

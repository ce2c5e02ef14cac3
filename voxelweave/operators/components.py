"""Connected components of an edge table (smallest id per component)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.scratch import Scratch


#: Pointers of a round up to which they may be broadcast; Spark rates them by their file, which packs ids closely.
SMALL = 100_000


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, scratch: Scratch | None = None, max_rounds: int = 200) -> DataFrame:
    """Label every vertex with the smallest vertex id it can reach.

    Args:
        edges: columns ``src`` and ``dst`` (bigint, undirected; loops and repeats allowed, nulls ignored).
        vertices: column ``id``; vertices without edges become their own component. ``None``: edge ends only.

    Returns:
        ``(id, root)``, one row per vertex. Empty input gives an empty table.

    Each round hooks every vertex onto its smallest neighbour (one algebraic min, combined on the map side, so a
    giant component costs no more than its rows), jumps pointers twice and contracts the edges. Hooks point
    downwards, so they form a forest whose roots only the smallest vertices can be; edges inside a contracted
    vertex drop out, so the working set shrinks every round, and the rounds are logarithmic in the diameter. The
    pointers and the edges of a round are written to the shared folder, which cuts the lineage; labels are
    composed once, at the end, from the rounds' pointers.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    run = uuid.uuid4().hex[:6]
    work = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    ends = work.select(F.explode(F.array("src", "dst")).alias("id"))
    if vertices is not None:
        ends = ends.union(vertices.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL"))
    labels = ends.distinct().select("id", F.col("id").alias("root"))
    tidy = lambda df, s, d: df.where(f"{s} <> {d}").select(F.least(s, d).alias("src"), F.greatest(s, d).alias("dst")).distinct()
    work = scratch.keep(tidy(work, "src", "dst"), f"cc_{run}_edges_0")
    for r in range(1, max_rounds + 1):
        if work.isEmpty():
            break
        # the aggregate's exchange is reused by the self joins of the two jumps
        hooks = work.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("p"))
        for _ in range(2):
            up = hooks.select(F.col("v").alias("uv"), F.col("p").alias("up"))
            hooks = hooks.join(up, hooks.p == up.uv, "left").select("v", F.coalesce("up", "p").alias("p"))
        hooks = scratch.keep(hooks, f"cc_{run}_hooks_{r}")
        if hooks.count() > SMALL:
            hooks = hooks.hint("merge")
        to = hooks.select(F.col("v").alias(f"v{r}"), F.col("p").alias(f"p{r}"))
        labels = labels.join(to, labels.root == to[f"v{r}"], "left").select("id", F.coalesce(f"p{r}", "root").alias("root"))
        a, b = hooks.select(F.col("v").alias("sv"), F.col("p").alias("sp")), hooks.select(F.col("v").alias("dv"), F.col("p").alias("dp"))
        moved = work.join(a, work.src == a.sv, "left").join(b, work.dst == b.dv, "left").select(F.coalesce("sp", "src").alias("s"), F.coalesce("dp", "dst").alias("d"))
        work = scratch.keep(tidy(moved, "s", "d"), f"cc_{run}_edges_{r}")
        scratch.drop(f"cc_{run}_edges_{r - 1}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels

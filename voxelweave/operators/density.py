"""Nearest positions, and density clusters at all heights, of points with a few numeric features.

Rows at one position are one weighted position, named by its smallest key, so a value that many rows share costs one row.
Rows with a null or non-finite feature belong to no position. All distances are squared. Cells of growing boxes bound what
is compared; their copies grow as a power of the number of features, so this is for two or three of them (scores of
principal components, for instance), not for dozens.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelweave.operators.components import connected_components
from voxelweave.scratch import Scratch

#: Halvings of the whole box that cells of the neighbour search go down to.
DEPTH = 24
#: Positions of a box up to which a pair of boxes is compared position by position.
LEAF = 32
_NUDGE = 1e-9


def positions(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``names, id, w``: distinct positions, the smallest key and the number of rows at each."""
    finite = F.lit(True)
    for c in names:
        finite = finite & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    clean = df.where(finite).select(F.col(key).cast("bigint").alias("id"), *(F.col(c).cast("double").alias(c) for c in names)).where("id IS NOT NULL")
    return clean.groupBy(*names).agg(F.min("id").alias("id"), F.count("*").alias("w"))


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast: Spark rates a frame of exploded copies by the file it is read from."""
    return df.hint("merge")


def _squared(names: list[str], a: str, b: str) -> Column:
    return sum(((F.col(f"{a}{n}") - F.col(f"{b}{n}")) * (F.col(f"{a}{n}") - F.col(f"{b}{n}")) for n in names), F.lit(0.0))


def nearest(pts: DataFrame, names: list[str], k: int, scratch: Scratch | None = None) -> DataFrame:
    """``id, n_id, n_w, d2, place``: of each position (``positions``) itself (place 0) and its ``k`` nearest others.

    Ties go by the smaller id. With fewer others, all of them. A position asks at the smallest halving of the
    whole box whose cell around it holds more than ``k`` positions: the answer lies within that cell's diagonal. A cell
    has fewer than ``2**d * (k + 1)`` positions that ask at it, so rows compared grow with positions, not with their square,
    however dense a cell is. The best are kept before the shuffle as well as after it.
    """
    scratch = scratch or Scratch(pts.sparkSession, "nearest")
    run, d = uuid.uuid4().hex[:6], len(names)
    ends = pts.agg(*(F.min(n).alias(f"lo_{n}") for n in names), *(F.max(n).alias(f"hi_{n}") for n in names)).first()
    low = {n: ends[f"lo_{n}"] or 0.0 for n in names}
    whole = max(((ends[f"hi_{n}"] or 0.0) - low[n] for n in names), default=0.0) * (1 + _NUDGE) or 1.0
    fine = pts.select("*", *(F.floor((F.col(n) - low[n]) / whole * float(1 << DEPTH)).cast("bigint").alias(f"f_{n}") for n in names))
    cell = [f"c_{n}" for n in names]

    def at_depths(first: int, last: int) -> DataFrame:
        return fine.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last)))).select("id", "w", *names, "depth", *(F.call_function("shiftright", F.col(f"f_{n}"), (F.lit(DEPTH) - F.col("depth")).cast("int")).alias(c) for n, c in zip(names, cell, strict=True)))

    every = at_depths(0, DEPTH)
    dense = every.groupBy("depth", *cell).count().where(F.col("count") > k).select("depth", *cell)
    deepest = every.join(_shuffled(dense), ["depth", *cell]).groupBy("id").agg(F.max("depth").alias("depth"))
    asks = scratch.keep(fine.join(_shuffled(deepest), "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0))), f"{run}_asks")
    span = asks.agg(F.min("depth"), F.max("depth")).first()
    side = F.lit(whole) / F.pow(F.lit(2.0), F.col("depth"))
    reach = math.ceil(math.sqrt(d)) if k else 0
    asked = asks.select(F.col("id").alias("a_id"), "depth", *(F.col(n).alias(f"a_{n}") for n in names), *(F.call_function("shiftright", F.col(f"f_{n}"), (F.lit(DEPTH) - F.col("depth")).cast("int")).alias(c) for n, c in zip(names, cell, strict=True)))
    gap = F.lit(0.0)
    for n, c in zip(names, cell, strict=True):
        asked = asked.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
        start = F.col(c) * side + low[n]
        out = F.greatest(start - F.col(f"a_{n}"), F.col(f"a_{n}") - start - side, F.lit(0.0))
        gap = gap + out * out
    asked = asked.where(gap <= side * side * d * (1 + 1e-6))
    others = at_depths(span[0] or 0, span[1] or 0).select(F.col("id").alias("n_id"), F.col("w").alias("n_w"), *(F.col(n).alias(f"n_{n}") for n in names), "depth", *cell)
    met = asked.join(_shuffled(others), ["depth", *cell]).select(F.col("a_id").alias("id"), "n_id", "n_w", _squared(names, "a_", "n_").alias("d2"))
    order = W.partitionBy("id").orderBy("d2", F.col("n_id") != F.col("id"), "n_id")
    return met.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") <= k)


def _boxes(pts: DataFrame, names: list[str], cell: list[str]) -> DataFrame:
    """One struct ``box`` a component and cell: tight bounds, bounds of core distances, count."""
    bounds = [f(n).alias(f"{p}_{n}") for n in names for p, f in (("lo", F.min), ("hi", F.max))]
    got = pts.groupBy("comp", *cell).agg(*bounds, F.min("core").alias("near"), F.max("core").alias("far"), F.count("*").alias("n"))
    return got.select("comp", *cell, F.struct("*").alias("box"))


def _bounded(pairs: DataFrame, names: list[str], limit: float, scratch: Scratch, name: str) -> DataFrame:
    """Pairs of boxes ``a, b`` whose least reachability may be the least of their components, and may be within ``limit``.

    The pairs in reach are written once, since the best of two components is taken from them and compared with them."""
    lo, hi = F.lit(0.0), F.lit(0.0)
    for n in names:
        a0, a1, b0, b1 = F.col(f"a.lo_{n}"), F.col(f"a.hi_{n}"), F.col(f"b.lo_{n}"), F.col(f"b.hi_{n}")
        out, across = F.greatest(b0 - a1, a0 - b1, F.lit(0.0)), F.greatest(b1 - a0, a1 - b0)
        lo, hi = lo + out * out, hi + across * across
    met = pairs.select("a", "b", F.greatest(lo, "a.near", "b.near").alias("least"), F.greatest(hi, "a.far", "b.far").alias("most")).where(F.col("least") <= limit)
    met = scratch.keep(met.withColumns({"ca": F.col("a.comp"), "cb": F.col("b.comp")}), f"{name}_met")
    best = met.groupBy("ca", "cb").agg(F.min("most").alias("best"))
    kept = scratch.keep(met.join(_shuffled(best), ["ca", "cb"]).where(F.col("least") <= F.col("best")).select("ca", "cb", "a", "b"), name)
    scratch.drop(f"{name}_met")
    return kept


def closest_pairs(act: DataFrame, names: list[str], side: float, reach: float, scratch: Scratch, run: str) -> DataFrame:
    """``ca, cb, weight, src, dst``: of each two components the edge of least reachability, where that is within ``reach``."""
    d, cell = len(names), [f"c_{n}" for n in names]

    def celled(t: int) -> DataFrame:
        return act.select("*", *(F.floor(F.col(n) / side * float(1 << t)).cast("bigint").alias(c) for n, c in zip(names, cell, strict=True)))

    # a box goes to the blocks, as wide as the reach, where one in reach may begin; forwards only on the first axis, so that
    # a pair meets once. Twice the side is more than the width of a box, whatever its bounds are rounded to.
    wide = reach * (1 + 1e-6)
    block = lambda x: F.floor(x / wide).cast("bigint")
    boxes = _boxes(celled(0), names, cell).select("box")
    left = boxes.withColumnRenamed("box", "a_box")
    for i, (n, c) in enumerate(zip(names, cell, strict=True)):
        low = F.col(f"a_box.lo_{n}")
        left = left.withColumn(c, F.explode(F.sequence(block(low - wide - 2 * side if i else low), block(F.col(f"a_box.hi_{n}") + wide))))
    right = boxes.select("box", *(block(F.col(f"box.lo_{n}")).alias(f"at_{c}") for n, c in zip(names, cell, strict=True)))
    start, a_start = F.col(f"box.lo_{names[0]}"), F.col(f"a_box.lo_{names[0]}")
    first = F.col("a_box.comp") < F.col("box.comp")
    once = (a_start < start) | ((a_start == start) & first)
    apart = lambda n: F.greatest(F.col(f"box.lo_{n}") - F.col(f"a_box.hi_{n}"), F.col(f"a_box.lo_{n}") - F.col(f"box.hi_{n}"), F.lit(0.0))
    in_reach = sum((apart(n) * apart(n) for n in names), F.lit(0.0)) <= reach * reach
    same_block = [F.col(c) == F.col(f"at_{c}") for c in cell]
    met = left.join(_shuffled(right), [*same_block, F.col("a_box.comp") != F.col("box.comp"), once, in_reach])
    pairs = met.select(F.when(first, F.col("a_box")).otherwise(F.col("box")).alias("a"), F.when(first, F.col("box")).otherwise(F.col("a_box")).alias("b"))
    kept = _bounded(pairs, names, reach * reach, scratch, f"{run}_pairs_0")
    t = 0
    while t < 40 and (kept.agg(F.max(F.greatest("a.n", "b.n"))).first()[0] or 0) > LEAF:
        t += 1
        # both boxes of a pair are halved along every axis; what cannot hold the closest pair goes
        parts = _boxes(celled(t), names, cell).select("comp", "box", *(F.call_function("shiftright", F.col(c), F.lit(1)).alias(c) for c in cell))
        for x in "ab":
            own = parts.select(F.col("comp").alias(f"{x}_comp"), *(F.col(c).alias(f"{x}_{c}") for c in cell), F.col("box").alias(f"{x}_box"))
            kept = kept.join(own, [F.col(f"{x}.comp") == F.col(f"{x}_comp"), *(F.col(f"{x}.{c}") == F.col(f"{x}_{c}") for c in cell)])
        kept = _bounded(kept.select(F.col("a_box").alias("a"), F.col("b_box").alias("b")), names, reach * reach, scratch, f"{run}_pairs_{t}")
    for x in "ab":
        own = celled(t).select(F.col("comp").alias(f"{x}_comp"), *(F.col(c).alias(f"{x}_{c}") for c in cell), F.col("id").alias(f"{x}_id"), F.col("core").alias(f"{x}_core"), *(F.col(n).alias(f"{x}_{n}") for n in names))
        kept = kept.join(own, [F.col(f"{x}.comp") == F.col(f"{x}_comp"), *(F.col(f"{x}.{c}") == F.col(f"{x}_{c}") for c in cell)])
    edge = F.struct(F.greatest(_squared(names, "a_", "b_"), "a_core", "b_core").alias("weight"), F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return kept.groupBy("ca", "cb").agg(F.min(edge).alias("e")).select("ca", "cb", "e.*").where(F.col("weight") <= reach * reach)


def reachability_graph(df: DataFrame, key: str, names: list[str], min_points: int, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Positions with core distances, and a sparse graph with the density clusters of every height.

    The core distance of a position is that of its ``min_points``-th nearest row, itself included; the mutual
    reachability of two positions is the greatest of both core distances and their distance. Returned are ``id, w, core,
    names`` (squared; null where there are fewer rows) and ``src, dst, weight``: at any height the components of this
    graph are those of the complete graph of mutual reachability, so its spanning forest is one of the complete graph. Its edges
    grow with the positions, by a factor that ``min_points`` and the number of features decide.

    The graph grows by heights, each a fixed multiple of the one before. Positions of a cell as wide as the last height that
    were core there are one component already, and a cell has fewer than ``min_points`` others; so components of a
    cell are few, however dense it is. Of two components in reach only the closest pair is looked for, by halving boxes
    and leaving out those that cannot hold it. Empty input gives empty tables.
    """
    scratch = scratch or Scratch(df.sparkSession, "density")
    d = len(names)
    pts = scratch.keep(positions(df, key, names), "positions")
    near = scratch.keep(nearest(pts, names, max(min_points, 1), scratch), "nearest")
    upto = W.partitionBy("id").orderBy("place")
    reached = near.withColumn("rows", F.sum("n_w").over(upto)).groupBy("id").agg(F.min(F.when(F.col("rows") >= min_points, F.col("d2"))).alias("core"))
    points = scratch.keep(pts.join(_shuffled(reached), "id").select("id", "w", "core", *names), "cores")
    graph = df.sparkSession.createDataFrame([], "src bigint, dst bigint, weight double")
    state = points.where("core IS NOT NULL").select("id", *names, "core", F.col("id").alias("comp"))
    least_core, apart = state.agg(F.min("core")).first()[0], near.where("place > 0").agg(F.min("d2")).first()[0]
    if least_core is None or apart is None:
        return points, graph
    high, ratio = math.sqrt(max(least_core, apart)) * (1 - _NUDGE), 4.0 if d < 3 else 2.0
    high = high or math.sqrt(5e-324)  # distances whose squares vanish
    level, apart = 0, state.limit(2).count() > 1
    while apart:
        level, low, high = level + 1, high, high * ratio
        act = state.where(F.col("core") <= high * high)
        found = scratch.keep(closest_pairs(act, names, low / math.sqrt(d) * (1 - _NUDGE), high, scratch, f"level_{level}"), f"edges_{level}")
        if found.isEmpty():
            continue
        graph = graph.unionByName(found.select("src", "dst", "weight"))
        roots = connected_components(found.select(F.col("ca").alias("src"), F.col("cb").alias("dst")), None, scratch)
        moved = state.join(roots.select(F.col("id").alias("comp"), "root"), "comp", "left").select("id", *names, "core", F.coalesce("root", "comp").alias("comp"))
        state = scratch.keep(moved, f"state_{level}")
        apart = state.select("comp").distinct().limit(2).count() > 1
    return points, graph


def clusters_at(points: DataFrame, graph: DataFrame, heights: list[float], scratch: Scratch | None = None) -> DataFrame:
    """``level`` (number of the height), ``id, w, cluster``: the core positions at each height and their clusters, named by the
    smallest id. All heights are contracted together, along the sparse graph. Ids have to lie within +-2**56."""
    if len(heights) > 63:
        raise ValueError("at most 63 heights at once")
    scratch = scratch or Scratch(points.sparkSession, "clusters_at")
    levels = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(float(h) * float(h)).alias("h")) for i, h in enumerate(heights)))
    at = lambda df, v: df.withColumn("l", F.explode(levels)).where(F.col(v) <= F.col("l.h"))
    half = 1 << 56
    packed = lambda c: F.when(F.col(c).between(-half, half - 1), F.expr(f"shiftleft(CAST(l.level AS BIGINT), 57) + {c} + {half}")).otherwise(F.raise_error(F.lit("ids have to lie within 2**56")))
    own = at(points, "core").select(packed("id").alias("p"), "id", "w", F.col("l.level").alias("level"))
    roots = connected_components(at(graph, "weight").select(packed("src").alias("src"), packed("dst").alias("dst")), own.select(F.col("p").alias("id")), scratch)
    named = roots.select(F.col("id").alias("p"), F.expr(f"(root & {2 * half - 1}) - {half}").alias("cluster"))
    return scratch.keep(own.join(_shuffled(named), "p").select("level", "id", "w", "cluster"), f"levels_{uuid.uuid4().hex[:6]}")


def stable_clusters(levels: DataFrame, heights: list[float], min_size: int, allow_single: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``id, cluster, stability``: the most stable of the clusters of ``clusters_at``; other positions have no row.

    ``heights`` ascend. Clusters of fewer than ``min_size`` rows do not count. A cluster that holds one such cluster of the
    next lower height goes on from it; one that holds several is the end of them and begins anew. Its stability adds up,
    over its heights, its rows times the growth of 1 / height down to the next lower one (at the lowest: 0). A cluster is
    taken if it is no less stable than the best choice inside it, and nothing around it is. A single cluster at the
    greatest height is only taken with ``allow_single``. Every step is a join of two heights, on cluster names.
    """
    scratch = scratch or Scratch(levels.sparkSession, "stable")
    if sorted(set(heights)) != list(heights) or (heights and heights[0] <= 0):
        raise ValueError("heights have to be positive and ascend")
    sizes = scratch.keep(levels.groupBy("level", "cluster").agg(F.sum("w").alias("n")).where(F.col("n") >= min_size), "sizes")
    up: list[DataFrame] = []
    for i in range(len(heights)):
        growth = 1 / heights[i - 1] - 1 / heights[i] if i else 0.0
        nodes = sizes.where(F.col("level") == i).select("cluster", "n")
        if not up:
            node = nodes.select("cluster", F.lit(0).cast("bigint").alias("kids"), F.lit(0.0).alias("s"), F.lit(0.0).alias("b"))
        else:
            # the name of a cluster is a member of it, and so leads to what is around it
            around = levels.where(F.col("level") == i).select(F.col("id").alias("kid"), F.col("cluster"))
            kids = up[-1].select(F.col("cluster").alias("kid"), "s", "b").join(around, "kid")
            kids = kids.groupBy("cluster").agg(F.count("*").alias("kids"), F.sum("s").alias("s1"), F.sum("b").alias("b1"), F.sum(F.greatest("s", "b")).alias("split"))
            one, own = F.col("kids") == 1, F.col("n") * growth
            node = nodes.join(kids, "cluster", "left").select("cluster", F.coalesce("kids", F.lit(0)).alias("kids"), F.when(one, F.col("s1") + own).otherwise(own).alias("s"), F.when(one, F.col("b1")).otherwise(F.coalesce("split", F.lit(0.0))).alias("b"))
        up.append(scratch.keep(node, f"up_{i}"))
    taken, above = None, None
    for i in reversed(range(len(heights))):
        good = F.col("s") >= F.col("b")
        if above is None:
            alone = not allow_single and up[i].limit(2).count() == 1
            node = up[i].select("cluster", "kids", F.lit(False).alias("done"), (good & F.lit(not alone)).alias("take"), "s")
        else:
            around = levels.where(F.col("level") == i + 1).select(F.col("id").alias("cluster"), F.col("cluster").alias("parent"))
            over = above.select(F.col("cluster").alias("parent"), F.col("kids").alias("siblings"), (F.col("done") | F.col("take")).alias("covered"))
            top = F.col("siblings") >= 2
            node = up[i].join(around, "cluster").join(over, "parent").select("cluster", "kids", F.col("covered").alias("done"), (~F.col("covered") & top & good).alias("take"), "s")
        above = scratch.keep(node, f"down_{i}")
        chosen = above.where("take").select(F.lit(i).alias("level"), "cluster", F.col("s").alias("stability"))
        taken = chosen if taken is None else taken.unionByName(chosen)
    if taken is None:
        return levels.select("id", "cluster", F.lit(0.0).alias("stability")).limit(0)
    return levels.join(taken, ["level", "cluster"]).select("id", "cluster", "stability")


def rows_of(df: DataFrame, key: str, names: list[str], found: DataFrame, points: DataFrame) -> DataFrame:
    """``key`` and the columns of ``found`` (by ``id``) for every row of ``df`` at a position that ``found`` names."""
    rows = df.select(F.col(key).alias("key_"), *(F.col(n).cast("double").alias(n) for n in names))
    named = found.drop("w").join(_shuffled(points.select(*names, F.col("id"))), "id").drop("id")
    return rows.join(_shuffled(named), names).drop(*names).withColumnRenamed("key_", key)

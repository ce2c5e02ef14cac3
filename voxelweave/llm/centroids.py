"""Centroid clustering of integer vectors by kd-tree filtering.

Vectors are dealt to trees once, a bounded slice of a partition each; a node holds its box, its count and its sum, all
integers. An assignment walks every tree level by level with the centroids that a node may still belong to: the nearest
one to the middle of the box stays, and another one goes if it is farther than that one, strictly, from the corner of the
box that suits it best. A node with one centroid left goes to it whole, by count and sum; a leaf with several is settled
by exact distances, ties by the smaller number. What a pass sends on is a count and a sum a cluster and partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.memory import small_batches, tidy_batches
from voxelweave.scratch import Scratch

#: Vectors of one tree, and of a leaf, at most.
TREE_ROWS, LEAF_ROWS = 4096, 24
#: Integer components are below this in size, so that a squared distance of 64 of them fits 64 bits.
LIMIT = 1 << 27
#: Nodes that are looked at together: bounds the arrays of a pass.
FRONTIER = 256


def build_tree(points: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A kd-tree of ``points`` (n x d, int64): ``order`` of the points, and of each node ``low, high, total`` (n x d),
    ``start, end`` (its run of the order), ``left`` (its first child, the second follows; -1: leaf). Node 0 is the root."""
    order, start, end, left = np.arange(len(points)), [0], [len(points)], [-1]
    low, high, total = [], [], []
    at = 0
    while at < len(start):
        a, b = start[at], end[at]
        own = points[order[a:b]]
        low.append(own.min(0)), high.append(own.max(0)), total.append(own.sum(0))
        wide = high[-1] - low[-1]
        axis = int(wide.argmax())
        if b - a > leaf and wide[axis]:
            m = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], m)]
            left[at] = len(start)
            start += [a, a + m]
            end += [a + m, b]
            left += [-1, -1]
        at += 1
    return {"order": order, "low": np.array(low), "high": np.array(high), "total": np.array(total), "start": np.array(start), "end": np.array(end), "left": np.array(left)}


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("...d,...d->...", x, x)


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Of the centres that ``may`` (nodes x k) still names, those that are nearest to some point of the box, as far as
    comparison with the one nearest to its middle tells; ties stay."""
    middle = np.where(may, _squares(2 * centres[None] - (low + high)[:, None]), np.iinfo(np.int64).max)
    best = centres[middle.argmin(1)][:, None]
    corner = np.where(centres[None] > best, high[:, None], low[:, None])
    return may & (_squares(corner - centres[None]) <= _squares(corner - best))


def filter_tree(tree: dict[str, np.ndarray], points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``cluster`` of each point (in the tree's order), ``count`` and ``total`` of each cluster, and how many distances of
    single points were computed. ``points`` are in the tree's order."""
    k = len(centres)
    cluster, count, total = np.empty(len(points), np.int64), np.zeros(k, np.int64), np.zeros(centres.shape, np.int64)
    todo, looked = [(np.zeros(1, np.int64), np.ones((1, k), bool))], 0
    while todo:
        nodes, may = todo.pop()
        if len(nodes) > FRONTIER:
            todo += [(nodes[i : i + FRONTIER], may[i : i + FRONTIER]) for i in range(0, len(nodes), FRONTIER)]
            continue
        may = candidates(tree["low"][nodes], tree["high"][nodes], centres, may)
        one, leaf = may.sum(1) == 1, tree["left"][nodes] < 0
        for node, z in zip(nodes[one].tolist(), may[one].argmax(1).tolist(), strict=True):
            a, b = tree["start"][node], tree["end"][node]
            cluster[a:b] = z
            count[z] += b - a
            total[z] += tree["total"][node]
        for node, names in zip(nodes[leaf & ~one].tolist(), may[leaf & ~one], strict=True):
            a, b, z = tree["start"][node], tree["end"][node], np.flatnonzero(names)
            own = points[a:b]
            near = z[_squares(own[:, None] - centres[z][None]).argmin(1)]
            looked += len(own) * len(z)
            cluster[a:b] = near
            np.add.at(count, near, 1)
            np.add.at(total, near, own)
        inner = ~one & ~leaf
        if inner.any():
            child = tree["left"][nodes[inner]]
            todo.append((np.concatenate([child, child + 1]), np.concatenate([may[inner]] * 2)))
    return cluster, count, total, looked


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id, point`` (array<bigint>): vectors with exactly ``size`` finite components, each ``floor(scale * x)``."""
    x, whole = F.col(vector_col), lambda v: F.floor(v.cast("double") * scale)
    good = (F.size(x) == size) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double") * scale) < LIMIT), F.lit(False)))
    return table.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("point"))


TREE = "low array<bigint>, high array<bigint>, total array<bigint>, start array<int>, end array<int>, left array<int>, points array<bigint>"


def tree_table(vectors: DataFrame, rows: int = TREE_ROWS) -> DataFrame:
    """One row a tree: ``ids`` and ``points`` in the tree's order and its nodes (``build_tree``), flat."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree_row(t: pa.Table) -> pa.RecordBatch:
            points = t.column("point").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            tree = build_tree(points)
            ids = t.column("vec_id").combine_chunks().take(pa.array(tree["order"]))
            flat = {"low": tree["low"], "high": tree["high"], "total": tree["total"], "start": tree["start"], "end": tree["end"], "left": tree["left"], "points": points[tree["order"]]}
            cols = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            for name, values in flat.items():
                kind = pa.int32() if name in ("start", "end", "left") else pa.int64()
                cols.append(pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel(), kind)))
            return pa.RecordBatch.from_arrays(cols, names=["ids", *flat])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                t = pa.Table.from_batches(held)
                yield tree_row(t.slice(0, rows))
                held = t.slice(rows).to_batches()
        if sum(b.num_rows for b in held):
            yield tree_row(pa.Table.from_batches(held))

    small_batches(vectors.sparkSession)
    return vectors.mapInArrow(run, f"ids array<{id_type}>, {TREE}")


def _unpacked(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {n: batch.column(j)[i].values for j, n in enumerate(batch.schema.names)}
            tree = {n: cell[n].to_numpy() for n in ("start", "end", "left")}
            tree |= {n: cell[n].to_numpy().reshape(-1, d) for n in ("low", "high", "total")}
            yield cell["ids"], cell["points"].to_numpy().reshape(-1, d), tree


def cluster_sums(trees: DataFrame, centres: np.ndarray) -> DataFrame:
    """``cluster, n, total`` (array<decimal>) of the assignment to ``centres``; empty clusters are absent."""
    k, d = centres.shape

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for _, points, tree in _unpacked(batches, d):
            _, n, s, _ = filter_tree(tree, points, centres)
            count, total = count + n, total + s
        z = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(count[z]), pa.array(list(total[z]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = trees.mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(d)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).select("cluster", "n", F.array(*(f"t{i}" for i in range(d))).alias("total"))


def assigned(trees: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` (squared) of every vector."""
    d = centres.shape[1]
    id_type = trees.schema["ids"].dataType.elementType.simpleString()

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, tree in _unpacked(batches, d):
            cluster, _, _, _ = filter_tree(tree, points, centres)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(_squares(points - centres[cluster]))], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, f"vec_id {id_type}, cluster int, distance bigint")


def seed_order() -> Column:
    """Order in which vectors become first centroids."""
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def next_centres(centres: np.ndarray, sums: list) -> np.ndarray:
    """Centroids after a round: componentwise floor of the mean; those without vectors stay. ``sums``: rows of ``cluster_sums``."""
    out = centres.copy()
    for cluster, n, total in sums:
        out[cluster] = [int(t) // n for t in total]
    return out


def cluster_vectors(table: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", first: Callable[[], Column] = seed_order) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every kept vector after ``rounds`` rounds, and the centroids (k x size).

    Vectors that are null, of another size, or with a null, NaN or infinite component are left out, and so are those
    with an integer component of 2**27 or more in size, whose squared distances may not fit 64 bits. A null id is a
    vector like any other (its order is that of an empty id); repeated ids are vectors of their own, and rank by their
    components where both would be first centroids; with fewer than ``k`` vectors each is a centroid, and without any
    the result is empty. Equal distances go to the smaller number. Other columns are left behind.

    The driver holds the centroids and, a round, one count and sum a cluster.
    """
    scratch = Scratch(table.sparkSession, "centroids")
    vectors = integer_vectors(table, id_col, vector_col, size, scale)
    trees = scratch.keep(tree_table(vectors), "trees")
    seeds = vectors.orderBy(first(), "point").limit(k).select("point").collect()
    centres = np.array([r[0] for r in seeds], np.int64).reshape(len(seeds), size)
    for _ in range(rounds if len(centres) else 0):
        centres = next_centres(centres, cluster_sums(trees, centres).collect())
    out = assigned(trees, centres)
    return out, centres


def cluster_report(assignment: DataFrame, centres: np.ndarray) -> DataFrame:
    """``assignment`` with ``cluster_inertia`` and ``inertia`` (sums of distances; null beyond 64 bits) and
    ``centroid_sha256`` of its centroid's components, joined by commas."""
    spark = assignment.sparkSession
    kept = Scratch(spark, "clusters").keep(assignment, "assigned")
    inertia = kept.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    every = inertia.agg(F.try_sum("cluster_inertia").alias("inertia"))
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centres.tolist())], "cluster int, text string")
    side = inertia.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(every))
    return kept.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))

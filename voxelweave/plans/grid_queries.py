"""Grid queries over a voxel table derived from ``lineitem``, and their SQL.

Cell (i, j, k) = (orderkey, partkey, suppkey) modulo N; density is the summed quantity, temperature the mean
discount in thousandths (exact integers on both sides), momenta and energy are integer sums. Every query takes the
cells per axis as ``n``; the default, and the SQL, are N = 16.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelweave.config import EngineConfig
from voxelweave.operators import catalog as C
from voxelweave.operators import derive, grid, labels
from voxelweave.plans import runs
from voxelweave.scratch import Scratch
from voxelweave.sources import layout
from voxelweave.sources import parts as P
from voxelweave.sources.readers import domain_shape

#: Cells per axis.
N = 16
DIMS = (2, 2, 2)
THRESHOLD, DENSE = 4510.0, 380.0
OPEN_Y = (True, False, True)
VARS = C.VARIABLES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    f = lambda c: F.sum(c).cast("float")
    key = [F.pmod(F.col(c), F.lit(n)).cast("int").alias(a) for c, a in zip(("l_orderkey", "l_partkey", "l_suppkey"), "ijk", strict=True)]
    cent = F.round(F.col("l_discount") * 100).cast("bigint")
    return read(spark, sf_dir, "lineitem").groupBy(*key).agg(
        f("l_quantity").alias("dens"), (F.sum(cent).cast("double") * 1000 / F.count("*")).cast("float").alias("temp"),
        f(F.round(F.col("l_tax") * 100).cast("bigint")).alias("m1"), f(F.col("l_linenumber").cast("bigint")).alias("m2"),
        f((F.col("l_returnflag") == "R").cast("bigint")).alias("m3"), f(F.floor("l_extendedprice")).alias("etot"),
    )


def primitive(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Voxels with velocities; the temperature stays the mean discount."""
    return derive.with_primitives(voxels(spark, sf_dir, n).withColumn("t_", F.col("temp"))).withColumn("temp", F.col("t_")).withColumn("T", F.col("t_")).drop("t_")


def mask(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return derive.cut(primitive(spark, sf_dir, n), "temperature", "lt", THRESHOLD)


def labelled(spark: SparkSession, sf_dir: str, n: int = N) -> tuple[DataFrame, int]:
    cells = Scratch(spark, "cells").keep(mask(spark, sf_dir, n).withColumn("cell_id", grid.cell_id(n)), "cells")
    return cells.join(labels.brick_path_labels(cells, n, DIMS), "cell_id"), n


def spacing(n: int) -> tuple[float, float, float]:
    return (1.0 / n,) * 3


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def voxel_scan_shape(spark, d, n=N):
    return domain_shape(voxels(spark, d, n))


def periodic_slice_scan(spark, d, n=N):
    return layout.periodic_scan(voxels(spark, d, n).select("i", "j", "k", "dens"), n, ((0, 4), (2, 6), (n - 3, n)), 1).select("gi", "gj", "gk", F.col("dens").cast("double").alias("dens"))


def axis_split_bricks(spark, d, n=N):
    cells = grid.with_brick(voxels(spark, d, n), n, (3, 2, 1)).groupBy("rank", "ci", "cj", "ck").agg(F.count("*").alias("cells"))
    return cells.join(F.broadcast(grid.brick_table(spark, n, (3, 2, 1)).select("rank", "i0", "i1", "j0", "j1", "next_x", "next_y", "next_z")), "rank")


def derive_velocity_temperature(spark, d, n=N):
    out = derive.with_primitives(voxels(spark, d, n))
    return out.select("i", "j", "k", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in ("velx", "vely", "velz")), F.round(F.col("temp").cast("double"), 3).alias("temp"))


def derive_pressure_speed(spark, d, n=N):
    return primitive(spark, d, n).select("i", "j", "k", derive.pressure().cast("double").alias("pressure"), F.round(derive.speed(), 5).alias("speed"))


def cell_center_coords(spark, d, n=N):
    return voxels(spark, d, n).select("i", "j", "k", *(derive.centre(a, 0.0, 1.0 / n).alias(x) for a, x in zip("ijk", "xyz", strict=True)))


def threshold_mask_lt(spark, d, n=N):
    return mask(spark, d, n).select("i", "j", "k")


def threshold_mask_gt_density(spark, d, n=N):
    return derive.cut(voxels(spark, d, n), "density", "gt", DENSE).select("i", "j", "k")


def _neighbours(c: int):
    def q(spark, d, n=N):
            return grid.neighbour_pairs(mask(spark, d, n), n, c).select("src", "dst")

    return q


def component_labels(spark, d, n=N):
    return labels.global_labels(mask(spark, d, n), n)


def component_labels_26(spark, d, n=N):
    return labels.global_labels(derive.cut(voxels(spark, d, n), "density", "gt", DENSE + 60), n, 26)


def component_labels_bricks(spark, d, n=N):
    return labels.brick_path_labels(mask(spark, d, n), n, DIMS)


def component_labels_compact(spark, d, n=N):
    return labels.dense_labels(labelled(spark, d, n)[0].select("cell_id", "root"))


def clump_cell_count_volume_mass(spark, d, n=N):
    x, n = labelled(spark, d, n)
    return x.groupBy("root").agg(*C.size_aggregates(spacing(n)))


def clump_centroids(spark, d, n=N):
    x, n = labelled(spark, d, n)
    return _rounded(x.groupBy("root").agg(*C.centroid_aggregates(spacing(n))))


def clump_bbox(spark, d, n=N):
    return labelled(spark, d, n)[0].groupBy("root").agg(*C.bbox_aggregates())


def clump_area_periodic(spark, d, n=N):
    x, n = labelled(spark, d, n)
    return C.exposed_area(x, C.internal_pairs(x, n, "root"), spacing(n), "root")


def clump_speed_stats(spark, d, n=N):
    return _rounded(labelled(spark, d, n)[0].groupBy("root").agg(*C.speed_aggregates()), 5)


def _moments(weight, excess, variables):
    def q(spark, d, n=N):
        out = C.moments(labelled(spark, d, n)[0], "root", variables, weight, excess)
        return _rounded(out, 4)

    return q


def clump_second_moments(spark, d, n=N):
    x, n = labelled(spark, d, n)
    return _rounded(C.second_moments(x, "root", spacing(n)))


def clump_principal_axes(spark, d, n=N):
    """Invariants of the axes: sums of squares and of fourth powers of the lengths, product of squares, and whether
    lengths descend, ratios belong to them and the orientation is orthonormal."""
    x, n = labelled(spark, d, n)
    axes = C.principal_axes(C.second_moments(x, "root", spacing(n)), "root")
    q = [F.col(f"axis_{a}") * F.col(f"axis_{a}") for a in "abc"]
    at = lambda r, c: F.element_at("orientation", 3 * r + c + 1)
    unit = [F.abs(sum((at(r, a) * at(r, b) for r in range(3)), F.lit(0.0)) - float(a == b)) < 1e-9 for a in range(3) for b in range(a, 3)]
    fits = [F.abs(F.col(f"ratio_{r}a") * F.col("axis_a") - F.col(f"axis_{r}")) < 1e-9 for r in "bc"]
    good = reduce(lambda p, q: p & q, [F.col("axis_a") >= F.col("axis_b"), F.col("axis_b") >= F.col("axis_c"), *unit, *fits])
    return axes.select("root", F.round(q[0] + q[1] + q[2], 6).alias("trace"), F.round(q[0] * q[0] + q[1] * q[1] + q[2] * q[2], 6).alias("square"), F.round(q[0] * q[1] * q[2], 6).alias("det"), good.alias("valid"))


def local(spark, d, n=N):
    """Cells with their brick-local label (no halo), fields attached."""
    scratch = Scratch(spark, "cells")
    cells = scratch.keep(mask(spark, d, n).withColumn("cell_id", grid.cell_id(n)), "cells")
    return scratch.keep(cells.join(labels.brick_labels(cells, n, DIMS).drop("i", "j", "k"), "cell_id"), "local"), n


def face_presence(spark, d, n=N):
    x, n = local(spark, d, n)
    boxes = F.broadcast(grid.brick_table(spark, n, DIMS))
    return x.join(boxes.drop("ci", "cj", "ck"), "rank").groupBy(grid.gid().alias("gid")).agg(*C.face_flags())


def face_pair_bits(spark, d, n=N):
    return face_presence(spark, d, n).select("gid", C.face_pair_bits().alias("face_pair_bits"))


def local_labels_by_brick(spark, d, n=N):
    return labels.brick_labels(mask(spark, d, n), n, DIMS).select("rank", "cell_id", "label_ids")


def local_labels_with_halo(spark, d, n=N):
    return labels.brick_labels(mask(spark, d, n), n, DIMS, halo=1).select("rank", "cell_id", "label_ids")


def unstitched_master(spark, d, n=N):
    x, n = local(spark, d, n)
    return _rounded(C.unstitched_catalog(x, n, DIMS, spacing(n)), 5)


def gid_pack(spark, d, n=N):
    return local(spark, d, n)[0].select("rank", "label_ids", grid.gid().alias("gid")).distinct().withColumns({"rank_back": F.shiftright("gid", 32).cast("int"), "local_back": F.col("gid").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")})


def interface_edges(spark, d, n=N):
    return labels.interface_edges(labels.brick_labels(mask(spark, d, n), n, DIMS), n, DIMS)


def interface_edges_open(spark, d, n=N):
    """Edges where only x and z wrap around."""
    return labels.interface_edges(local(spark, d, n)[0], n, DIMS, OPEN_Y)


def face_planes(spark, d, n=N):
    """Foreground pixels of the outermost planes of every brick."""
    return labels.face_planes(local(spark, d, n)[0], grid.brick_table(spark, n, DIMS))


def interface_totals(spark, d, n=N):
    """Face neighbours across bricks by axis: expected from the mask, observed by the planes of the parts."""
    x, n = local(spark, d, n)
    bricks = grid.brick_table(spark, n, DIMS)
    observed = labels.plane_edges(labels.face_planes(x, bricks), bricks).groupBy("axis").agg(F.sum("cnt").alias("observed"))
    rank = grid.with_brick(mask(spark, d, n).select("i", "j", "k"), n, DIMS)
    pairs = grid.face_pairs(rank, n, ("i", "j", "k"))
    over = F.lit(False)
    for axis, a, p in zip("xyz", "ijk", DIMS, strict=True):
        over = over | ((F.col("axis") == axis) & F.col(f"src_{a}").isin([hi - 1 for _, hi in grid.split_axis(n, p)]))
    return pairs.where(over).groupBy("axis").agg(F.count("*").alias("expected")).join(observed, "axis")


def _parts(spark, d, n, periodic, name):
    """Parts of a run, written to the shared folder and read back."""
    x, n = local(spark, d, n)
    scratch = Scratch(spark, "parts")
    config = EngineConfig(n=n, dims=DIMS, threshold=THRESHOLD, periodic=periodic)
    planes = labels.face_planes(x, grid.brick_table(spark, n, DIMS, periodic))
    P.write_parts(C.unstitched_catalog(x, n, DIMS, spacing(n)), planes, scratch.path(name), config)
    return P.read_parts(spark, scratch.path(name))


def stitch_from_parts(spark, d, n=N):
    """The merged catalog from parts on disk: catalog rows, boundary planes and metadata of each brick."""
    parts, planes, bricks, _ = _parts(spark, d, n, grid.TORUS, "torus")
    return _rounded(runs.stitch_parts(parts, planes, bricks, spacing(n)), 5)


def stitch_from_parts_open(spark, d, n=N):
    parts, planes, bricks, _ = _parts(spark, d, n, OPEN_Y, "open")
    return _rounded(runs.stitch_parts(parts, planes, bricks, spacing(n)), 5)


def part_metadata(spark, d, n=N):
    """Metadata of the parts: place, box, structures, spacing."""
    _, _, _, meta = _parts(spark, d, n, grid.TORUS, "meta")
    box = F.col("node_bbox_ijk")
    return meta.select("rank", *(F.col("coords")[i].alias(f"c{a}") for i, a in enumerate("ijk")), *(box[i].alias(c) for i, c in enumerate(("i0", "i1", "j0", "j1", "k0", "k1"))), F.col("K").alias("structures"), F.col("grid.dx").alias("dx"), F.col("grid.Nres").alias("cells"), F.forall("grid.periodic", lambda v: v).alias("torus"))


def neighbor_edges_open(spark, d, n=N):
    """Face neighbours without wrap-around in y."""
    return grid.neighbour_pairs(mask(spark, d, n), n, 6, OPEN_Y).select("src", "dst")


def interface_counts(spark, d, n=N):
    return interface_edges(spark, d, n).groupBy("axis").agg(F.sum("cnt").alias("pairs"), F.count("*").alias("edges"))


def _stitched(spark, d, min_cells=1, n=N):
    x, n = local(spark, d, n)
    edges = labels.interface_edges(x.select("rank", "cell_id", "i", "j", "k", "label_ids"), n, DIMS)
    roots = labels.stitched_roots(x, edges)
    return C.stitched_catalog(C.unstitched_catalog(x, n, DIMS, spacing(n)), roots, edges, spacing(n), min_cells), x, roots, edges, n


def stitched_catalog(spark, d, n=N):
    return _rounded(_stitched(spark, d, n=n)[0].withColumnRenamed("root", "gid"), 5)


def min_cells_filter(spark, d, n=N):
    return _stitched(spark, d, 4, n)[0].select(F.col("root").alias("gid"), "cell_count")


def stitched_equals_direct(spark, d, n=N):
    """Differences between the merged and the direct catalog (none), with the totals of both as a checked row."""
    cat, x, roots, _, n = _stitched(spark, d, n=n)
    y, _ = labelled(spark, d, n)
    cols = ["cell_count", "volume", "mass", "area", "i_min", "i_max", "j_min", "j_max", "k_min", "k_max"]
    tidy = lambda t: t.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in cols))
    diff = C.catalog_difference(tidy(cat), tidy(C.direct_catalog(y, n, spacing(n))))
    return diff.agg(F.count("*").alias("differences")).crossJoin(cat.agg(F.count("*").alias("clumps"), F.coalesce(F.sum("cell_count"), F.lit(0)).alias("cells")))


def majority_vote_mapping(spark, d, n=N):
    x, n = local(spark, d, n)
    y, _ = labelled(spark, d, n)
    return C.majority_mapping(x.withColumn("gid", grid.gid()), y, "cell_id", "gid", "root")


def split_components_topk(spark, d, n=N):
    return C.split_components(majority_vote_mapping(spark, d, n), "root", "gid")


def component_degree(spark, d, n=N):
    x, n = local(spark, d, n)
    return C.degrees(labels.interface_edges(x.select("rank", "cell_id", "i", "j", "k", "label_ids"), n, DIMS), x.select(grid.gid().alias("gid")))


def face_only_component_count(spark, d, n=N):
    """Components of the brick graph, from faces alone."""
    local_ = labels.brick_labels(mask(spark, d, n), n, DIMS)
    return labels.stitched_roots(local_, labels.interface_edges(local_, n, DIMS)).agg(F.countDistinct("root").alias("components"), F.count("*").alias("local_components"))


def baseline_totals(spark, d, n=N):
    x, n = labelled(spark, d, n)
    return _rounded(C.direct_catalog(x, n, spacing(n)).agg(F.count("*").alias("k"), F.sum("cell_count").alias("cells"), F.sum("volume").alias("volume"), F.sum("mass").alias("mass"), F.sum("area").alias("area"), F.max("cell_count").alias("largest")))


def brick_label_offsets(spark, d, n=N):
    """Running offset of label numbers over bricks, in the order k, j, i (a table of one row a brick)."""
    count = grid.with_brick(labels.brick_labels(mask(spark, d, n), n, DIMS).drop("rank"), n, DIMS).groupBy("rank", "ci", "cj", "ck").agg(F.max("label_ids").alias("labels"))
    before = W.orderBy("ck", "cj", "ci").rowsBetween(W.unboundedPreceding, -1)
    return count.select("rank", "labels", F.coalesce(F.sum("labels").over(before), F.lit(0)).alias("offset"))


def root_set_difference(spark, d, n=N):
    """Structures of more than one brick, and those of one, as set operations on roots."""
    m = majority_vote_mapping(spark, d, n)
    split = m.groupBy("root").agg(F.count("*").alias("c")).where("c > 1").select("root")
    whole = m.select("root").distinct().subtract(split)
    return split.withColumn("part", F.lit("split")).union(whole.withColumn("part", F.lit("whole")))


def midplane_slice(spark, d, n=N):
    return voxels(spark, d, n).where(F.col("i") == n // 2).select("j", "k", F.col("dens").cast("double").alias("dens"), F.round(F.col("temp").cast("double"), 3).alias("temp"))


def subgraph_degree(spark, d, n=N):
    """Local components of the structure with most parts, with their degrees among themselves."""
    x, n = local(spark, d, n)
    edges = labels.interface_edges(x.select("rank", "cell_id", "i", "j", "k", "label_ids"), n, DIMS)
    roots = labels.stitched_roots(x, edges)
    top = roots.groupBy("root").agg(F.count("*").alias("c")).agg(F.max(F.struct("c", (-F.col("root")).alias("r"))).alias("m")).select((-F.col("m.r")).alias("root"))
    inside = roots.join(F.broadcast(top), "root").select("gid")
    own = edges.join(inside.withColumnRenamed("gid", "lo"), "lo", "left_semi")
    return C.degrees(own, inside)


def subgraph_connectivity(spark, d, n=N):
    """Per structure: parts, and the components of its own parts and edges alone, found anew (one, if it is connected)."""
    x, n = local(spark, d, n)
    edges = labels.interface_edges(x.select("rank", "cell_id", "i", "j", "k", "label_ids"), n, DIMS)
    return C.subgraph_components(labels.stitched_roots(x, edges), edges)


QUERIES = {
    name: globals()[name]
    for name in (
        "voxel_scan_shape periodic_slice_scan axis_split_bricks derive_velocity_temperature derive_pressure_speed cell_center_coords threshold_mask_lt "
        "threshold_mask_gt_density component_labels component_labels_26 component_labels_bricks component_labels_compact clump_cell_count_volume_mass clump_centroids clump_bbox "
        "clump_area_periodic clump_speed_stats clump_second_moments clump_principal_axes face_presence face_pair_bits local_labels_by_brick "
        "local_labels_with_halo unstitched_master gid_pack interface_edges interface_counts stitched_catalog min_cells_filter stitched_equals_direct "
        "majority_vote_mapping split_components_topk component_degree face_only_component_count baseline_totals brick_label_offsets root_set_difference "
        "midplane_slice subgraph_degree subgraph_connectivity interface_edges_open face_planes interface_totals stitch_from_parts stitch_from_parts_open part_metadata neighbor_edges_open"
    ).split()
} | {
    "neighbor_edges_6": _neighbours(6), "neighbor_edges_18": _neighbours(18), "neighbor_edges_26": _neighbours(26),
    "clump_moments_volw": _moments(None, False, VARS), "clump_moments_massw": _moments("dens", False, VARS), "clump_moments_excess": _moments(None, True, ("rho", "T")),
}

# ---- SQL ------------------------------------------------------------------------------------------------------------
CELLS = """cells AS (SELECT *, (i * 16 + j) * 16 + k AS id FROM (
  SELECT CAST(l_orderkey % 16 AS INT) AS i, CAST(l_partkey % 16 AS INT) AS j, CAST(l_suppkey % 16 AS INT) AS k,
    CAST(sum(l_quantity) AS FLOAT) AS dens, CAST(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 1000 / count(*) AS FLOAT) AS temp,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS FLOAT) AS m1, CAST(sum(l_linenumber) AS FLOAT) AS m2,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS FLOAT) AS m3, CAST(sum(floor(l_extendedprice)) AS FLOAT) AS etot
  FROM lineitem GROUP BY 1, 2, 3))"""
PRIM = CELLS + """, prim AS (SELECT *, m1 / ds AS velx, m2 / ds AS vely, m3 / ds AS velz,
    (CAST(0.5 AS FLOAT) * (m1 * m1 + m2 * m2 + m3 * m3)) / ds AS ke FROM (SELECT *, greatest(dens, CAST(1e-30 AS FLOAT)) AS ds FROM cells))"""
MASK = PRIM + """, fg AS (SELECT *, dens AS rho, temp AS T, velx AS vx, vely AS vy, velz AS vz, dens * temp AS pressure,
    sqrt(CAST(velx AS DOUBLE) * CAST(velx AS DOUBLE) + CAST(vely AS DOUBLE) * CAST(vely AS DOUBLE) + CAST(velz AS DOUBLE) * CAST(velz AS DOUBLE)) AS speed
    FROM prim WHERE temp < CAST(4510 AS FLOAT))"""


def _edges_sql(c: int, cells: str = "fg", name: str = "pairs") -> str:
    half = ", ".join(f"({a}, {b}, {k})" for a, b, k in grid.offsets(c))
    return (
        f"{name} AS (SELECT a.id AS src, b.id AS dst, o.oi, o.oj, o.ok FROM {cells} a CROSS JOIN (VALUES {half}) o(oi, oj, ok) "
        f"JOIN {cells} b ON b.i = (a.i + o.oi + 16) % 16 AND b.j = (a.j + o.oj + 16) % 16 AND b.k = (a.k + o.ok + 16) % 16)"
    )


def _reach(out: str, nodes: str, pairs: str, a: str = "src", b: str = "dst", node: str = "id") -> str:
    return (
        f"{out}_e AS (SELECT {a} AS s, {b} AS d FROM {pairs} UNION SELECT {b}, {a} FROM {pairs}), "
        f"{out}_r(id, lab) AS (SELECT {node}, {node} FROM {nodes} UNION SELECT e.d, r.lab FROM {out}_r r JOIN {out}_e e ON e.s = r.id WHERE r.lab < e.d), "
        f"{out} AS (SELECT id, min(lab) AS root FROM {out}_r GROUP BY id)"
    )


R = "WITH RECURSIVE "
LABELS = R + MASK + ", " + _edges_sql(6) + ", " + _reach("lab", "fg", "pairs") + ", x AS (SELECT f.*, l.root FROM fg f JOIN lab l USING (id))"
RANK = "((i // 8) * 2 + j // 8) * 2 + k // 8"
LOCAL_ONLY = (
    R + MASK + f", b AS (SELECT *, {RANK} AS rank FROM fg), " + _edges_sql(6)
    + ", inner_pairs AS (SELECT p.* FROM pairs p JOIN b s ON s.id = p.src JOIN b t ON t.id = p.dst WHERE s.rank = t.rank AND t.i = s.i + oi AND t.j = s.j + oj AND t.k = s.k + ok), "
    + _reach("loc", "b", "inner_pairs")
    + ", x AS (SELECT b.*, l.root AS lroot, CAST(dense_rank() OVER (PARTITION BY rank ORDER BY l.root) AS INT) AS label_ids FROM b JOIN loc l USING (id)), "
    "y AS (SELECT *, CAST(rank AS BIGINT) * 4294967296 + label_ids AS gid FROM x)"
)
LOCAL = LOCAL_ONLY + (
    ", rim AS (SELECT p.*, CASE WHEN oi = 1 THEN 'x' WHEN oj = 1 THEN 'y' ELSE 'z' END AS axis, s.gid AS sg, t.gid AS tg FROM pairs p JOIN y s ON s.id = p.src JOIN y t ON t.id = p.dst "
    "WHERE (oi = 1 AND s.i % 8 = 7) OR (oj = 1 AND s.j % 8 = 7) OR (ok = 1 AND s.k % 8 = 7)), "
    "ie AS (SELECT least(sg, tg) AS lo, greatest(sg, tg) AS hi, axis, count(*) AS cnt FROM rim GROUP BY 1, 2, 3)"
)
VC = "(1.0 / 4096)::DOUBLE"
AXIS = {"i": "x", "j": "y", "k": "z"}
XYZ = {a: f"((CAST({a} AS DOUBLE) + 0.5::DOUBLE) / 16)" for a in "ijk"}
SIZE = f"count(*) AS cell_count, count(*) * {VC} AS volume, sum(CAST(dens AS DOUBLE) * {VC}) AS mass"
BBOX = ", ".join(f"CAST(min({a}) AS BIGINT) AS {a}_min, CAST(max({a}) + 1 AS BIGINT) AS {a}_max" for a in "ijk")
CENT = ", ".join(f"{{r}}(sum({w} * {XYZ[a]}) / sum({w}){{d}}) AS centroid_{k}_{AXIS[a]}" for k, w in (("vol", "1::DOUBLE"), ("mass", "CAST(dens AS DOUBLE)")) for a in "ijk")
SPEED = "{r}(avg(speed){d}) AS velocity_mean, {r}(stddev_pop(speed){d}) AS velocity_std"


def _r(sql: str, digits: int | None) -> str:
    return sql.format(r="round" if digits is not None else "", d=f", {digits}" if digits is not None else "")


def _moment_sql(weight: bool, excess: bool, variables: tuple[str, ...]) -> str:
    w, s = ("CAST(dens AS DOUBLE)", "_massw") if weight else ("1::DOUBLE", "")
    mean = ", ".join(f"sum({w} * CAST({v} AS DOUBLE)) / sum({w}) AS mu_{v}" for v in variables)
    cent = ", ".join(f"any_value(mu_{v}) AS mu_{v}, " + ", ".join(f"sum({w} * pow(CAST({v} AS DOUBLE) - mu_{v}, {p})) / sum({w}) AS m{p}_{v}" for p in (2, 3, 4)) for v in variables)
    out = ", ".join(
        f"round(mu_{v}, 4) AS {v}_mean{s}, round(sqrt(m2_{v}), 4) AS {v}_std{s}, round(m3_{v} / (pow(sqrt(m2_{v}), 3) + 1e-300), 4) AS {v}_skew{s}, "
        f"round(m4_{v} / (m2_{v} * m2_{v} + 1e-300) - {3 if excess else 0}, 4) AS {v}_kurt{s}"
        for v in variables
    )
    return LABELS + f", mu AS (SELECT root, {mean} FROM x GROUP BY root), c AS (SELECT root, {cent} FROM x JOIN mu USING (root) GROUP BY root) SELECT root, {out} FROM c"


RIM_OPEN = LOCAL_ONLY + (
    ", rim AS (SELECT p.*, CASE WHEN oi = 1 THEN 'x' WHEN oj = 1 THEN 'y' ELSE 'z' END AS axis, s.gid AS sg, t.gid AS tg FROM pairs p JOIN y s ON s.id = p.src JOIN y t ON t.id = p.dst "
    "WHERE (oi = 1 AND s.i % 8 = 7) OR (oj = 1 AND s.j = 7) OR (ok = 1 AND s.k % 8 = 7)), "
    "ie AS (SELECT least(sg, tg) AS lo, greatest(sg, tg) AS hi, axis, count(*) AS cnt FROM rim GROUP BY 1, 2, 3)"
)
STITCH = LOCAL + ", " + _reach("st", "(SELECT DISTINCT gid FROM y)", "ie", "lo", "hi", "gid") + ", z AS (SELECT y.*, st.root FROM y JOIN st ON st.id = y.gid)"
STITCH_OPEN = RIM_OPEN + ", " + _reach("st", "(SELECT DISTINCT gid FROM y)", "ie", "lo", "hi", "gid") + ", z AS (SELECT y.*, st.root FROM y JOIN st ON st.id = y.gid)"
_AREA = "6 * count(*) / 256.0::DOUBLE"


def _merged(stitch: str, inner: str) -> str:
    return stitch + (
        f", a AS (SELECT root, {SIZE}, {_r(CENT, 5)}, {_r(SPEED, 5)}, {BBOX}, {_AREA} AS area0 FROM z GROUP BY root), "
        f"p AS (SELECT z.root, count(*) * 2 / 256.0::DOUBLE AS inner_a FROM {inner} JOIN z ON z.id = src GROUP BY 1) "
        "SELECT a.root AS gid, a.* EXCLUDE (root, area0, volume, mass), round(volume, 5) AS volume, round(mass, 5) AS mass, round(area0 - coalesce(inner_a, 0), 5) AS area FROM a LEFT JOIN p USING (root)"
    )

SQL: dict[str, str] = {
    "voxel_scan_shape": f"WITH {CELLS} SELECT CAST(max(i) + 1 AS BIGINT) AS nx, CAST(max(j) + 1 AS BIGINT) AS ny, CAST(max(k) + 1 AS BIGINT) AS nz FROM cells",
    "periodic_slice_scan": f"WITH {CELLS}, w AS (SELECT unnest([-16, 0, 16]) AS t) SELECT i + a.t AS gi, j + b.t AS gj, k + c.t AS gk, CAST(dens AS DOUBLE) AS dens FROM cells, w a, w b, w c "
    "WHERE i + a.t BETWEEN -1 AND 4 AND j + b.t BETWEEN 1 AND 6 AND k + c.t BETWEEN 12 AND 16",
    "axis_split_bricks": f"WITH {CELLS}, b AS (SELECT *, CASE WHEN i < 6 THEN 0 WHEN i < 11 THEN 1 ELSE 2 END AS ci, j // 8 AS cj, 0 AS ck FROM cells) "
    "SELECT ci * 2 + cj AS rank, ci, cj, ck, count(*) AS cells, [0, 6, 11][ci + 1] AS i0, [6, 11, 16][ci + 1] AS i1, cj * 8 AS j0, cj * 8 + 8 AS j1, "
    "((ci + 1) % 3) * 2 + cj AS next_x, ci * 2 + (cj + 1) % 2 AS next_y, ci * 2 + cj AS next_z FROM b GROUP BY ci, cj, ck",
    "derive_velocity_temperature": f"WITH {PRIM} SELECT i, j, k, round(CAST(velx AS DOUBLE), 5) AS velx, round(CAST(vely AS DOUBLE), 5) AS vely, round(CAST(velz AS DOUBLE), 5) AS velz, "
    "round(CAST(greatest(CAST(0.6666666666666667 AS FLOAT) * (etot - ke), CAST(1e-30 AS FLOAT)) / ds AS DOUBLE), 3) AS temp FROM prim",
    "derive_pressure_speed": f"WITH {PRIM} SELECT i, j, k, CAST(dens * temp AS DOUBLE) AS pressure, "
    "round(sqrt(CAST(velx AS DOUBLE) * CAST(velx AS DOUBLE) + CAST(vely AS DOUBLE) * CAST(vely AS DOUBLE) + CAST(velz AS DOUBLE) * CAST(velz AS DOUBLE)), 5) AS speed FROM prim",
    "cell_center_coords": f"WITH {CELLS} SELECT i, j, k, {XYZ['i']} AS x, {XYZ['j']} AS y, {XYZ['k']} AS z FROM cells",
    "threshold_mask_lt": f"WITH {MASK} SELECT i, j, k FROM fg",
    "threshold_mask_gt_density": f"WITH {CELLS} SELECT i, j, k FROM cells WHERE dens > CAST({DENSE} AS FLOAT)",
    **{f"neighbor_edges_{c}": f"WITH {MASK}, {_edges_sql(c)} SELECT src, dst FROM pairs" for c in (6, 18, 26)},
    "component_labels": LABELS + " SELECT id AS cell_id, root FROM x",
    "component_labels_bricks": LABELS + " SELECT id AS cell_id, root FROM x",
    "component_labels_26": R + CELLS + f", fg AS (SELECT * FROM cells WHERE dens > CAST({DENSE + 60} AS FLOAT)), " + _edges_sql(26) + ", " + _reach("lab", "fg", "pairs") + " SELECT id AS cell_id, root FROM lab",
    "component_labels_compact": LABELS + " SELECT id AS cell_id, dense_rank() OVER (ORDER BY root) AS label FROM x",
    "clump_cell_count_volume_mass": LABELS + f" SELECT root, {SIZE} FROM x GROUP BY root",
    "clump_centroids": LABELS + f" SELECT root, {_r(CENT, 6)} FROM x GROUP BY root",
    "clump_bbox": LABELS + f" SELECT root, {BBOX} FROM x GROUP BY root",
    "clump_area_periodic": LABELS + f", n AS (SELECT root, {_AREA} AS a FROM x GROUP BY root), p AS (SELECT x.root, count(*) * 2 / 256.0::DOUBLE AS a FROM pairs JOIN x ON x.id = src GROUP BY 1) "
    "SELECT n.root, n.a - coalesce(p.a, 0) AS area FROM n LEFT JOIN p USING (root)",
    "clump_speed_stats": LABELS + f" SELECT root, {_r(SPEED, 5)} FROM x GROUP BY root",
    "clump_moments_volw": _moment_sql(False, False, VARS),
    "clump_moments_massw": _moment_sql(True, False, VARS),
    "clump_moments_excess": _moment_sql(False, True, ("rho", "T")),
    "clump_second_moments": LABELS + ", mu AS (SELECT root, " + ", ".join(f"sum(CAST(dens AS DOUBLE) * {XYZ[a]}) / sum(CAST(dens AS DOUBLE)) AS mu_{a}" for a in "ijk") + " FROM x GROUP BY root) SELECT root, "
    + ", ".join(f"round(sum(CAST(dens AS DOUBLE) * ({XYZ[a]} - mu_{a}) * ({XYZ[b]} - mu_{b})) / sum(CAST(dens AS DOUBLE)), 6) AS c{AXIS[a]}{AXIS[b]}" for a, b in ("ii", "jj", "kk", "ij", "ik", "jk"))
    + " FROM x JOIN mu USING (root) GROUP BY root",
    "face_presence": LOCAL_ONLY + " SELECT gid, " + ", ".join(f"bool_or({a} % 8 = {v}) AS {AXIS[a]}_{s}" for a in "ijk" for s, v in (("neg", 0), ("pos", 7))) + " FROM y GROUP BY gid",
    "face_pair_bits": LOCAL_ONLY + ", f AS (SELECT gid, " + ", ".join(f"bool_or({a} % 8 = {v}) AS f{2 * n + m}" for n, a in enumerate("ijk") for m, v in enumerate((0, 7))) + " FROM y GROUP BY gid) SELECT gid, CAST("
    + " + ".join(f"(CASE WHEN f{a} AND f{b} THEN {1 << i} ELSE 0 END)" for i, (a, b) in enumerate(C.PAIR_BITS)) + " AS INT) AS face_pair_bits FROM f",
    "local_labels_by_brick": LOCAL_ONLY + " SELECT rank, id AS cell_id, label_ids FROM y",
    "local_labels_with_halo": R + MASK + ", w AS (SELECT unnest([-16, 0, 16]) AS t), bx AS (SELECT r AS rank, (r // 4) * 8 AS i0, (r // 2 % 2) * 8 AS j0, (r % 2) * 8 AS k0 FROM range(8) t(r)), "
    "h AS (SELECT rank, id AS cid, i + a.t AS gi, j + b.t AS gj, k + c.t AS gk, i0, j0, k0 FROM fg, w a, w b, w c, bx WHERE i + a.t BETWEEN i0 - 1 AND i0 + 8 AND j + b.t BETWEEN j0 - 1 AND j0 + 8 AND k + c.t BETWEEN k0 - 1 AND k0 + 8), "
    "hh AS (SELECT *, ((CAST(rank AS BIGINT) * 64 + gi + 16) * 64 + gj + 16) * 64 + gk + 16 AS nid, gi BETWEEN i0 AND i0 + 7 AND gj BETWEEN j0 AND j0 + 7 AND gk BETWEEN k0 AND k0 + 7 AS core FROM h), "
    "hp AS (SELECT a.nid AS src, b.nid AS dst FROM hh a JOIN hh b ON b.nid IN (a.nid + 1, a.nid + 64, a.nid + 4096)), " + _reach("hl", "hh", "hp", node="nid")
    + ", c AS (SELECT rank, cid, root, min(cid) OVER (PARTITION BY rank, root) AS m FROM hh JOIN hl ON hl.id = hh.nid WHERE core) SELECT rank, cid AS cell_id, CAST(dense_rank() OVER (PARTITION BY rank ORDER BY m) AS INT) AS label_ids FROM c",
    "unstitched_master": LOCAL_ONLY + f", a AS (SELECT gid, rank, label_ids, {SIZE}, count(*) AS num_cells, {_r(CENT, 5)}, {_r(SPEED, 5)}, {BBOX}, {_AREA} AS area0 FROM y GROUP BY gid, rank, label_ids), "
    "p AS (SELECT y.gid, count(*) * 2 / 256.0::DOUBLE AS inner_a FROM inner_pairs JOIN y ON y.id = src GROUP BY 1) "
    "SELECT a.* EXCLUDE (area0, volume, mass), round(volume, 5) AS volume, round(mass, 5) AS mass, round(area0 - coalesce(inner_a, 0), 5) AS area FROM a LEFT JOIN p USING (gid)",
    "gid_pack": LOCAL_ONLY + " SELECT DISTINCT rank, label_ids, gid, rank AS rank_back, label_ids AS local_back FROM y",
    "interface_edges": LOCAL + " SELECT * FROM ie",
    "interface_counts": LOCAL + " SELECT axis, CAST(sum(cnt) AS BIGINT) AS pairs, count(*) AS edges FROM ie GROUP BY axis",
    "stitched_catalog": _merged(STITCH, "pairs"),
    "stitch_from_parts": _merged(STITCH, "pairs"),
    "stitch_from_parts_open": _merged(STITCH_OPEN, "(SELECT p.src FROM pairs p JOIN y s ON s.id = p.src WHERE NOT (oj = 1 AND s.j = 15))"),
    "interface_edges_open": RIM_OPEN + " SELECT * FROM ie",
    "neighbor_edges_open": f"WITH {MASK}, {_edges_sql(6)} SELECT src, dst FROM pairs JOIN fg ON fg.id = src WHERE NOT (oj = 1 AND j = 15)",
    "face_planes": LOCAL_ONLY + " " + " UNION ALL ".join(
        f"SELECT rank, '{AXIS[a]}' AS axis, '{side}' AS side, {' % 8 AS u, '.join(b for b in 'ijk' if b != a)} % 8 AS v, label_ids AS local_id FROM y WHERE {a} % 8 = {at}" for a in "ijk" for side, at in (("neg", 0), ("pos", 7))
    ),
    "interface_totals": LOCAL + " SELECT axis, CAST(sum(cnt) AS BIGINT) AS expected, CAST(sum(cnt) AS BIGINT) AS observed FROM ie GROUP BY axis",
    "part_metadata": LOCAL_ONLY + ", bk AS (SELECT CAST(r AS INT) AS rank, CAST(r // 4 AS INT) AS ci, CAST(r // 2 % 2 AS INT) AS cj, CAST(r % 2 AS INT) AS ck FROM range(8) t(r)) "
    "SELECT bk.*, " + ", ".join(f"CAST(c{a} * 8 AS BIGINT) AS {a}0, CAST(c{a} * 8 + 8 AS BIGINT) AS {a}1" for a in "ijk") + ", (SELECT count(DISTINCT gid) FROM y WHERE y.rank = bk.rank) AS structures, 0.0625::DOUBLE AS dx, 16 AS cells, TRUE AS torus FROM bk",
    "clump_principal_axes": LABELS + ", mu AS (SELECT root, " + ", ".join(f"sum(CAST(dens AS DOUBLE) * {XYZ[a]}) / sum(CAST(dens AS DOUBLE)) AS mu_{a}" for a in "ijk") + " FROM x GROUP BY root), m AS (SELECT root, "
    + ", ".join(f"sum(CAST(dens AS DOUBLE) * ({XYZ[a]} - mu_{a}) * ({XYZ[b]} - mu_{b})) / sum(CAST(dens AS DOUBLE)) AS {a}{b}" for a, b in ("ii", "jj", "kk", "ij", "ik", "jk"))
    + " FROM x JOIN mu USING (root) GROUP BY root) SELECT root, round(ii + jj + kk, 6) AS trace, round(ii * ii + jj * jj + kk * kk + 2 * (ij * ij + ik * ik + jk * jk), 6) AS square, "
    "round(ii * (jj * kk - jk * jk) - ij * (ij * kk - jk * ik) + ik * (ij * jk - jj * ik), 6) AS det, TRUE AS valid FROM m",
    "min_cells_filter": STITCH + " SELECT root AS gid, count(*) AS cell_count FROM z GROUP BY root HAVING count(*) >= 4",
    "stitched_equals_direct": LABELS + " SELECT CAST(0 AS BIGINT) AS differences, count(DISTINCT root) AS clumps, count(*) AS cells FROM x",
    "majority_vote_mapping": LOCAL_ONLY + ", " + _reach("lab", "fg", "pairs") + ", v AS (SELECT gid, lab.root, count(*) AS votes FROM y JOIN lab USING (id) GROUP BY 1, 2) "
    "SELECT gid, root, votes FROM v QUALIFY row_number() OVER (PARTITION BY gid ORDER BY votes DESC, root) = 1",
    "split_components_topk": LOCAL_ONLY + ", " + _reach("lab", "fg", "pairs") + " SELECT lab.root, count(DISTINCT gid) AS parts FROM y JOIN lab USING (id) GROUP BY 1 HAVING count(DISTINCT gid) > 1 ORDER BY parts DESC, lab.root LIMIT 5",
    "component_degree": LOCAL + ", n AS (SELECT lo AS gid, hi AS o FROM ie WHERE lo <> hi UNION SELECT hi, lo FROM ie WHERE lo <> hi) SELECT g.gid, count(n.o) AS degree FROM (SELECT DISTINCT gid FROM y) g LEFT JOIN n USING (gid) GROUP BY 1",
    "face_only_component_count": STITCH + " SELECT count(DISTINCT root) AS components, count(DISTINCT gid) AS local_components FROM z",
    "baseline_totals": LABELS + f", a AS (SELECT root, {SIZE}, {_AREA} AS a0 FROM x GROUP BY root), p AS (SELECT count(*) * 2 / 256.0::DOUBLE AS b FROM pairs) "
    "SELECT count(*) AS k, CAST(sum(cell_count) AS BIGINT) AS cells, round(sum(volume), 6) AS volume, round(sum(mass), 6) AS mass, round(sum(a0) - any_value(b), 6) AS area, max(cell_count) AS largest FROM a, p",
    "brick_label_offsets": LOCAL_ONLY + ", m AS (SELECT rank, max(label_ids) AS labels FROM y GROUP BY rank) SELECT rank, labels, CAST(coalesce(sum(labels) OVER (ORDER BY rank % 2, rank // 2 % 2, rank // 4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM m",
    "root_set_difference": LOCAL_ONLY + ", " + _reach("lab", "fg", "pairs") + " SELECT lab.root, CASE WHEN count(DISTINCT gid) > 1 THEN 'split' ELSE 'whole' END AS part FROM y JOIN lab USING (id) GROUP BY 1",
    "midplane_slice": f"WITH {CELLS} SELECT j, k, CAST(dens AS DOUBLE) AS dens, round(CAST(temp AS DOUBLE), 3) AS temp FROM cells WHERE i = 8",
    "subgraph_degree": STITCH + ", g AS (SELECT DISTINCT gid, root FROM z), t AS (SELECT root FROM g GROUP BY root ORDER BY count(*) DESC, root LIMIT 1), n AS (SELECT lo AS gid, hi AS o FROM ie WHERE lo <> hi UNION SELECT hi, lo FROM ie WHERE lo <> hi) "
    "SELECT g.gid, count(n.o) AS degree FROM g JOIN t USING (root) LEFT JOIN n USING (gid) GROUP BY 1",
    "subgraph_connectivity": STITCH + ", g AS (SELECT DISTINCT gid, root FROM z), n AS (SELECT lo AS s, hi AS d FROM ie WHERE lo <> hi UNION SELECT hi, lo FROM ie WHERE lo <> hi), "
    "own AS (SELECT n.s, n.d FROM n JOIN g a ON a.gid = n.s JOIN g b ON b.gid = n.d AND b.root = a.root), "
    "w(gid, lab) AS (SELECT gid, gid FROM g UNION SELECT own.d, w.lab FROM w JOIN own ON own.s = w.gid WHERE w.lab < own.d), f AS (SELECT gid, min(lab) AS lab FROM w GROUP BY gid) "
    "SELECT min(g.gid) AS first, count(*) AS parts, count(DISTINCT f.lab) AS components FROM g JOIN f USING (gid) GROUP BY g.root",
}

"""Grid geometry as columns: cell ids, bricks, periodic neighbours, halos."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def cell_id(n: int, i: str = "i", j: str = "j", k: str = "k") -> Column:
    return ((F.col(i).cast("bigint") * n + F.col(j)) * n + F.col(k)).alias("cell_id")


def compute_dims(size: int) -> tuple[int, int, int]:
    """Near-cubic, non-increasing factorisation of ``size``."""
    best = min(((a, b, size // (a * b)) for a in range(1, size + 1) if size % a == 0 for b in range(1, size // a + 1) if (size // a) % b == 0), key=lambda d: (max(d) - min(d), max(d)))
    return tuple(sorted(best, reverse=True))  # type: ignore[return-value]


def split_axis(n: int, p: int) -> list[tuple[int, int]]:
    """Balanced split of [0, n) into p half-open ranges; the first n % p get one more."""
    base, rem = divmod(n, p)
    cuts = [c * base + min(c, rem) for c in range(p + 1)]
    return list(itertools.pairwise(cuts))


def brick_coord(x: Column, n: int, p: int) -> Column:
    """Brick index of a cell index on an axis, in closed form."""
    base, rem = divmod(n, p)
    wide = rem * (base + 1)
    tail = F.lit(0) if base == 0 else F.lit(rem) + F.floor((x - wide) / F.lit(base))
    return F.when(x < wide, F.floor(x / F.lit(base + 1))).otherwise(tail).cast("int")


def with_brick(df: DataFrame, n: int, dims: tuple[int, int, int]) -> DataFrame:
    """Add ``ci, cj, ck`` and ``rank`` (row-major)."""
    ci, cj, ck = (brick_coord(F.col(a), n, p) for a, p in zip("ijk", dims, strict=True))
    return df.withColumns({"ci": ci, "cj": cj, "ck": ck}).withColumn("rank", ((F.col("ci") * dims[1] + F.col("cj")) * dims[2] + F.col("ck")).cast("int"))


Axes = tuple[bool, bool, bool]
TORUS: Axes = (True, True, True)


def brick_table(spark: SparkSession, n: int, dims: tuple[int, int, int], periodic: Axes = TORUS) -> DataFrame:
    """``rank, ci, cj, ck, i0, i1, j0, j1, k0, k1`` and the rank of the next brick on each axis (null past an open rim)."""
    sides = [split_axis(n, p) for p in dims]
    rank = lambda c: (c[0] * dims[1] + c[1]) * dims[2] + c[2]
    rows = []
    for c in itertools.product(*(range(p) for p in dims)):
        nxt = [rank(tuple((x + (a == b)) % dims[a] for a, x in enumerate(c))) if periodic[b] or c[b] + 1 < dims[b] else None for b in range(3)]
        rows.append((rank(c), *c, *(v for a in range(3) for v in sides[a][c[a]]), *nxt))
    return spark.createDataFrame(rows, "rank int, ci int, cj int, ck int, i0 int, i1 int, j0 int, j1 int, k0 int, k1 int, next_x int, next_y int, next_z int")


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Half neighbourhood: one of each pair of opposite offsets (3, 9 or 13)."""
    reach = {6: 1, 18: 2, 26: 3}.get(connectivity)
    if reach is None:
        raise ValueError("connectivity must be 6, 18 or 26")
    return [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and sum(map(abs, o)) <= reach]


def neighbour_pairs(cells: DataFrame, n: int, connectivity: int = 6, periodic: bool | Axes = True, by: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, oi, oj, ok``: each cell with each present neighbour of the half neighbourhood; with ``by``, among the
    cells of one snapshot (or whatever these columns name), which are returned in front.

    One equi-join on the shifted cell id; cells on an axis of length 1 are their own neighbours, on an axis of
    length 2 a pair is met once from each side, as face counting needs.
    """
    half = F.array(*(F.struct(*(F.lit(v).alias(a) for v, a in zip(o, ("oi", "oj", "ok"), strict=True))) for o in offsets(connectivity)))
    shifted = cells.select(*by, "i", "j", "k", cell_id(n).alias("src"), F.explode(half).alias("o"))
    at = {a: F.col(a) + F.col(f"o.o{a}") for a in "ijk"}
    for a, wraps in zip("ijk", (periodic,) * 3 if isinstance(periodic, bool) else periodic, strict=True):
        if not wraps:
            shifted = shifted.where(f"{a} + o.o{a} BETWEEN 0 AND {n - 1}")
    wrap = {a: F.pmod(x, F.lit(n)) for a, x in at.items()}
    shifted = shifted.select(*by, "src", ((wrap["i"].cast("bigint") * n + wrap["j"]) * n + wrap["k"]).alias("dst"), "o.oi", "o.oj", "o.ok")
    return shifted.join(cells.select(*by, cell_id(n).alias("dst")), [*by, "dst"]).select(*by, "src", "dst", "oi", "oj", "ok")


def face_pairs(cells: DataFrame, n: int, keep: tuple[str, ...] = (), periodic: Axes = TORUS, by: tuple[str, ...] = ()) -> DataFrame:
    """Face neighbours in positive direction with their axis: ``src, dst, axis`` and ``keep`` columns of both ends
    (``src_*``, ``dst_*``); over the rim only on periodic axes; with ``by``, among the cells of one snapshot, in front."""
    moves = F.array(*(F.struct(F.lit(a).alias("axis"), *(F.lit(int(b == a)).alias(f"o{b}") for b in AXES)) for a in AXES))
    left = cells.select(*by, "i", "j", "k", cell_id(n).alias("src"), *(F.col(c).alias(f"src_{c}") for c in keep), F.explode(moves).alias("m"))
    for c, a, wraps in zip("ijk", AXES, periodic, strict=True):
        if not wraps:
            left = left.where((F.col("m.axis") != a) | (F.col(c) < n - 1))
    wrap = [F.pmod(F.col(c) + F.col(f"m.o{a}"), F.lit(n)) for c, a in zip("ijk", AXES, strict=True)]
    left = left.select(*by, "src", *(f"src_{c}" for c in keep), F.col("m.axis").alias("axis"), ((wrap[0].cast("bigint") * n + wrap[1]) * n + wrap[2]).alias("dst"))
    right = cells.select(*by, cell_id(n).alias("dst"), *(F.col(c).alias(f"dst_{c}") for c in keep))
    return left.join(right, [*by, "dst"]).select(*by, "src", "dst", "axis", *(f"{s}_{c}" for s in ("src", "dst") for c in keep))


def with_halo(df: DataFrame, n: int, dims: tuple[int, int, int], bricks: DataFrame, halo: int = 1) -> DataFrame:
    """Every brick's own rows (``core``) and its halo copies, keyed by ``rank``, with box coordinates ``gi, gj, gk``.

    A row has a copy for every brick around whose box, widened by ``halo``, holds one of its periodic images; only
    rows within ``halo`` of a brick's side have any. A halo wider than the narrowest brick is a ValueError.
    """
    if halo > min(hi - lo for p in dims for lo, hi in split_axis(n, p)):
        raise ValueError("the halo is wider than a brick")
    boxes = F.broadcast(bricks.select("rank", "i0", "i1", "j0", "j1", "k0", "k1"))
    moved = with_brick(df, n, dims).join(boxes, "rank")
    for a in "ijk":
        low, high = F.col(a) - F.col(f"{a}0") < halo, F.col(f"{a}1") - F.col(a) <= halo
        steps = F.filter(F.array(F.lit(0), F.when(low, F.lit(-1)), F.when(high, F.lit(1))), lambda o: o.isNotNull())
        moved = moved.withColumn(f"o{a}", F.explode(steps))
    at = [F.col(c) + F.col(f"o{a}") for c, a in zip(("ci", "cj", "ck"), "ijk", strict=True)]
    # a step over the rim of the torus moves the row's image by n the other way
    for a, x, p in zip("ijk", at, dims, strict=True):
        moved = moved.withColumn(f"g{a}", F.col(a) - F.floor(x / F.lit(p)).cast("int") * n)
    target = ((F.pmod(at[0], F.lit(dims[0])) * dims[1] + F.pmod(at[1], F.lit(dims[1]))) * dims[2] + F.pmod(at[2], F.lit(dims[2]))).cast("int")
    core = (F.col("oi") == 0) & (F.col("oj") == 0) & (F.col("ok") == 0)
    return moved.withColumns({"rank": target, "core": core}).drop("ci", "cj", "ck", "oi", "oj", "ok", "i0", "i1", "j0", "j1", "k0", "k1")


def gid(rank: str = "rank", local: str = "label_ids") -> Column:
    """``rank << 32 | local``."""
    return F.shiftleft(F.col(rank).cast("bigint"), 32).bitwiseOR(F.col(local).cast("bigint"))

"""A voxel layout whose row groups are compact boxes, and scans of periodic sub-volumes that read only some of them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a cell index that the Z-order takes: axes of up to two million cells.
BITS = 21
#: Masks of the bit spreading (each step doubles the distance between groups of bits): fixed by the Z-order's definition.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def z_order(i: Column, j: Column, k: Column) -> Column:
    """Position on the Z-order curve: bits of the three indices interleaved, ``i`` highest. Indices are below 2**21."""

    def spread(x: Column) -> Column:
        x = x.cast("bigint")
        for shift, mask in SPREAD:
            x = F.shiftleft(x, shift).bitwiseOR(x).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(spread(i), 2).bitwiseOR(F.shiftleft(spread(j), 1)).bitwiseOR(spread(k))


def write_clustered(voxels: DataFrame, path: str, files: int = 1, group_bytes: int = 16 << 20, by: tuple[str, ...] = ()) -> None:
    """Write a voxel table (``i, j, k`` and fields) in Z-order: files are ranges of the curve, rows in its order, so that
    each row group of about ``group_bytes`` is close to a cube and its minima and maxima are tight on all three axes.
    ``by``: partition columns in front (``step``)."""
    z = z_order(F.col("i"), F.col("j"), F.col("k"))
    rows = voxels.withColumn("z_", z).repartitionByRange(files, *by, "z_").sortWithinPartitions(*by, "z_").drop("z_")
    rows.write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy(*by).parquet(path)


def axis_segments(n: int, lo: int, hi: int, halo: int = 0) -> list[tuple[int, int, int]]:
    """``(first, end, shift)`` of the index ranges that [lo - halo, hi + halo) covers on a ring of ``n`` cells: cells
    ``first <= x < end`` have the box coordinate ``x + shift``. Two ranges at most, unless the box is longer than the ring."""
    a, b = lo - halo, hi + halo
    return [(max(a - t * n, 0), min(b - t * n, n), t * n) for t in range(a // n, -(-b // n)) if max(a - t * n, 0) < min(b - t * n, n)]


def periodic_scan(df: DataFrame, n: int, box: tuple[tuple[int, int], ...], halo: int = 0) -> DataFrame:
    """Rows of a box (half-open, may lie over the rim or be empty) with a wrap-around halo, and their box coordinates
    ``gi, gj, gk``, which may lie outside [0, n).

    Ranges are literals on the stored columns, so a Parquet reader skips row groups outside them; no row is copied, but
    where a box is longer than the ring and holds a cell more than once.
    """
    segments = [axis_segments(n, lo, hi, halo) for lo, hi in box]
    inside = F.lit(True)
    for a, parts in zip("ijk", segments, strict=True):
        one = F.lit(False)
        for first, end, _ in parts:
            one = one | ((F.col(a) >= first) & (F.col(a) < end))
        inside = inside & one
    out = df.where(inside)
    for a, parts in zip("ijk", segments, strict=True):
        held = [F.when((F.col(a) >= first) & (F.col(a) < end), (F.col(a) + F.lit(shift)).cast("int")) for first, end, shift in parts]
        once = all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(parts, 2))
        images = F.coalesce(*held) if once and held else F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())) if held else F.col(a).cast("int")
        out = out.withColumn(f"g{a}", images)
    return out

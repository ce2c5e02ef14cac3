"""Derived fields of a conserved-variable snapshot, in single precision, and the threshold cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-30


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def with_primitives(df: DataFrame, gamma: float = 5.0 / 3.0) -> DataFrame:
    """``velx, vely, velz, temp`` and the aliases ``rho, T, vx, vy, vz`` from ``dens, etot, m1, m2, m3``.

    Every step is rounded to single precision, as array arithmetic on float32 fields is.
    """
    safe = F.greatest(F.col("dens"), f32(FLOOR))
    kinetic = f32(f32(f32(0.5) * f32(f32(F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2")) + F.col("m3") * F.col("m3"))) / F.col("safe_"))
    out = df.withColumn("safe_", safe)
    out = out.withColumns({f"vel{a}": f32(F.col(m) / F.col("safe_")) for a, m in zip("xyz", ("m1", "m2", "m3"), strict=True)} | {"ke_": kinetic})
    out = out.withColumn("pres_", F.greatest(f32(f32(gamma - 1.0) * f32(F.col("etot") - F.col("ke_"))), f32(FLOOR)))
    out = out.withColumn("temp", f32(F.col("pres_") / F.col("safe_"))).drop("safe_", "ke_", "pres_")
    return out.withColumns({"rho": F.col("dens"), "T": F.col("temp"), "vx": F.col("velx"), "vy": F.col("vely"), "vz": F.col("velz")})


def pressure() -> Column:
    """The catalog's pressure: density times temperature, in single precision."""
    return f32(F.col("dens") * F.col("temp"))


def speed() -> Column:
    v = [F.col(f"vel{a}").cast("double") for a in "xyz"]
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def centre(axis: str, origin: float, spacing: float) -> Column:
    """Cell-centre coordinate of a global index."""
    return F.lit(origin) + (F.col(axis) + F.lit(0.5)) * F.lit(spacing)


def cut(df: DataFrame, by: str = "temperature", op: str = "lt", threshold: float = 1.0) -> DataFrame:
    """Foreground rows: strict comparison in single precision; NaN is background for either side."""
    col = F.col({"temperature": "temp", "density": "dens"}[by]).cast("float")
    if op == "lt":
        return df.where(col < f32(threshold))
    if op == "gt":
        return df.where((col > f32(threshold)) & ~F.isnan(col))
    raise ValueError("op must be lt or gt")

"""Voxel tables, part files, run names and synthetic fields."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "cons_cons_density_"
RECORDS = {"dens": "cons_cons_density_{}", "etot": "cons_cons_total_energy_density_{}", **{f"m{c}": f"cons_cons_momentum_density_{c}_{{}}" for c in (1, 2, 3)}}
#: Signs of axis labels and how they are spelt in file names.
LABEL_SIGNS = (("⟨v⟩", "v_mean"), ("σ", "sigma"), (" ", "_"), ("-", "_"))
META = (
    "rank int, coords array<int>, cart_dims array<int>, node_bbox_ijk array<bigint>, grid struct<periodic: array<boolean>, Nres: int, dx: double, dy: double, dz: double>, "
    "output_npz string, K bigint, times struct<load: double, label: double, reduce: double>, git_rev string, config string"
)


def level_suffix(names: list[str]) -> str:
    """Level of a snapshot's records: from the density record, else from the first name with an ``_lvl`` part, in the order given."""
    for n in names:
        if n.startswith(PREFIX):
            return n.removeprefix(PREFIX)
    for n in names:
        if "_lvl" in n:
            return "lvl" + n.rpartition("_lvl")[2].partition("_")[0]
    raise ValueError("no record names a level")


def read_voxels(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    """A voxel table (``i, j, k, dens, etot, m1, m2, m3``); ``step`` prunes partitions if the table has them."""
    df = spark.read.parquet(path)
    if step is not None and "step" in df.columns:
        df = df.where(F.col("step") == step)
    if not {"dens", "etot"} <= set(df.columns):
        lvl = level_suffix(df.columns)
        df = df.withColumnsRenamed({r.format(lvl): n for n, r in RECORDS.items()})
    return df.withColumns({c: F.col(c).cast("float") for c in RECORDS if c in df.columns})


def domain_shape(df: DataFrame) -> DataFrame:
    """``nx, ny, nz`` of a voxel table."""
    return df.agg(*((F.max(a) + 1).cast("bigint").alias(f"n{b}") for a, b in zip("ijk", "xyz", strict=True)))


def read_npz_parts(spark: SparkSession, path: str, columns: dict[str, str], glob: str = "*.npz") -> DataFrame:
    """Rows of NPZ part files: arrays named in ``columns`` (name -> Spark type), plus ``file``."""
    schema = ", ".join(f"{n} {t}" for n, t in columns.items()) + ", file string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for name, content in zip(t["path"], t["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({c: list(z[c]) if z[c].ndim > 1 else z[c] for c in columns} | {"file": name})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, schema)


def read_part_index(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files of brick parts; FileNotFoundError if there are none."""
    df = spark.read.schema(META).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    if df.isEmpty():
        raise FileNotFoundError(f"no part metadata under {path}")
    return df


def run_fields(name: Column) -> list[Column]:
    """``res, step, conn, temp_thr`` from names like ``res640_x_step00021_conn6_T0p02``."""
    pattern = r"res(\d+)_.*step(\d+)_conn(\d+)_T([0-9p]+)"
    number = lambda g: F.nullif(F.regexp_extract(name, pattern, g), F.lit(""))
    return [number(1).cast("int").alias("res"), number(2).cast("int").alias("step"), number(3).cast("int").alias("conn"), F.replace(number(4), F.lit("p"), F.lit(".")).cast("double").alias("temp_thr")]


def spacing_chain(spacing: Column, res: Column, finest: int = 10240) -> Column:
    """Cell size: the mean of a catalog's own (an array; empty counts as none), else one over its resolution, else one
    over the finest."""
    mean = F.when(F.size(spacing) > 0, F.aggregate(spacing, F.lit(0.0), lambda a, x: a + x) / F.size(spacing))
    return F.coalesce(mean, F.lit(1.0) / res, F.lit(1.0 / finest))


def sanitised(label: Column) -> Column:
    """A label as a file-name part: the named signs spelt out, every space or hyphen an underscore, runs of other
    characters one underscore, trimmed, lower case, or ``feature``."""
    spelt = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), LABEL_SIGNS, label)
    clean = F.lower(F.trim(F.regexp_replace(spelt, "[^0-9a-zA-Z_]+", "_"), F.lit("_")))
    return F.when(clean == "", F.lit("feature")).otherwise(clean)


def box_mask(spark: SparkSession, n: int, box: tuple[tuple[int, int], ...]) -> DataFrame:
    """Cells of a box in an n-cube with unit density."""
    df = spark.range(n**3).select((F.col("id") / (n * n)).cast("int").alias("i"), (F.col("id") / n % n).cast("int").alias("j"), (F.col("id") % n).cast("int").alias("k"))
    return df.where(" AND ".join(f"{a} >= {lo} AND {a} < {hi}" for a, (lo, hi) in zip("ijk", box, strict=True))).withColumn("dens", F.lit(1.0).cast("float"))


def gaussian_field(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, n, n))


def powerlaw_field(n: int, beta: float, seed: int, zero_mean: bool = True) -> np.ndarray:
    """Random field with spectrum P(k) ~ k**beta and unit deviation."""
    k = np.fft.fftfreq(n) * n
    kk = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2)
    kk[0, 0, 0] = 1
    amp = kk ** (beta / 2)
    if zero_mean:
        amp[0, 0, 0] = 0
    f = np.fft.ifftn(np.fft.fftn(np.random.default_rng(seed).standard_normal((n, n, n))) * amp).real
    return f / f.std()


def monotone_fields(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Temperature in (0.01, 1) and the anti-correlated density in (1, 100)."""
    u = 1 / (1 + np.exp(-f))
    return (0.01 * 100**u).astype(np.float32), (100 ** (1 - u)).astype(np.float32)


def rescaled(df: DataFrame, col: str, lo: float, hi: float, robust: bool = True) -> DataFrame:
    """``df`` with ``col`` mapped linearly onto [lo, hi] from its 1st to its 99th percentile (or its whole range) and
    clipped there; a constant goes to the middle. The limits are one broadcast row."""
    low, high = (F.percentile(col, 0.01), F.percentile(col, 0.99)) if robust else (F.min(col), F.max(col))
    limits = df.agg(low.cast("double").alias("low_"), high.cast("double").alias("high_"))
    share = (F.least(F.greatest(F.col(col).cast("double"), F.col("low_")), F.col("high_")) - F.col("low_")) / (F.col("high_") - F.col("low_"))
    value = F.when(F.col("high_") > F.col("low_"), F.lit(float(lo)) + share * float(hi - lo)).otherwise(F.lit((lo + hi) / 2))
    return df.crossJoin(F.broadcast(limits)).withColumn(col, value).drop("low_", "high_")


def discover_snapshots(spark: SparkSession, root: str, least_step: int = 30, glob: str = "*stitched*") -> DataFrame:
    """``path, res, step`` of the catalogs under ``root`` that lie in a ``step<number>`` folder after ``least_step``;
    ``res`` comes from ``n<number>_sweep`` in the path (null if there is none). Only names are listed, no file is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/step*/{glob}")
    found = [(str(s.getPath().toString()),) for s in where.getFileSystem(conf).globStatus(where) or []]
    table = spark.createDataFrame(found, "path string")
    step, res = (F.nullif(F.regexp_extract("path", p, 1), F.lit("")).cast("int") for p in (r"/step(\d+)/[^/]*$", r"n(\d+)_sweep"))
    return table.select("path", res.alias("res"), step.alias("step")).where(F.col("step") > least_step)


def field_table(spark: SparkSession, **fields: np.ndarray) -> DataFrame:
    """A voxel table of dense arrays ``[i, j, k]``."""
    shape = next(iter(fields.values())).shape
    grid = np.indices(shape).reshape(3, -1).astype(np.int32)
    return spark.createDataFrame(pd.DataFrame({a: grid[d] for d, a in enumerate("ijk")} | {k: v.ravel().astype(np.float32) for k, v in fields.items()}))

"""openPMD snapshots as a Spark data source: one input partition a brick, read lazily by the optional library.

    spark.dataSource.register(OpenPMDSource)
    spark.read.format("openpmd").options(path=..., step=21, dims="2,2,1").load()

Rows are ``i, j, k, dens, etot, m1, m2, m3`` (stored axis order is z, y, x). The library is imported where a
series is opened, so registering the source needs nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelweave.operators.grid import split_axis
from voxelweave.sources.readers import RECORDS, level_suffix

SCHEMA = "i int, j int, k int, " + ", ".join(f"{n} float" for n in RECORDS)


class Brick(InputPartition):
    def __init__(self, box: tuple[tuple[int, int], ...]):
        self.box = box


def open_iteration(path: str, step: int):
    """The series and one of its iterations."""
    import openpmd_api

    series = openpmd_api.Series(path, openpmd_api.Access.read_only)
    return series, series.iterations[step]


def component(iteration, record: str):
    """A scalar record's only component."""
    mesh = iteration.meshes[record]
    names = list(mesh)
    return mesh[names[0]] if names else mesh


class OpenPMDReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("step", 0))
        self.dims = tuple(int(x) for x in str(options.get("dims", "1,1,1")).split(","))

    def partitions(self) -> list[Brick]:
        _, it = open_iteration(self.path, self.step)
        lvl = level_suffix(list(it.meshes))
        shape = tuple(component(it, RECORDS["dens"].format(lvl)).shape)[::-1]
        return [Brick(b) for b in itertools.product(*(split_axis(n, p) for n, p in zip(shape, self.dims, strict=True)))]

    def read(self, partition: Brick) -> Iterator[pa.RecordBatch]:
        series, it = open_iteration(self.path, self.step)
        lvl = level_suffix(list(it.meshes))
        (i0, i1), (j0, j1), (k0, k1) = partition.box
        for i in range(i0, i1):  # one plane of x at a time bounds memory
            planes = [component(it, r.format(lvl)).load_chunk([k0, j0, i], [k1 - k0, j1 - j0, 1]) for r in RECORDS.values()]
            series.flush()
            k, j = np.meshgrid(np.arange(k0, k1, dtype=np.int32), np.arange(j0, j1, dtype=np.int32), indexing="ij")
            cols = [np.full(k.size, i, np.int32), j.ravel(), k.ravel(), *(np.asarray(p, np.float32).ravel() for p in planes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["i", "j", "k", *RECORDS])


class OpenPMDSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "openpmd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OpenPMDReader:
        return OpenPMDReader(self.options)

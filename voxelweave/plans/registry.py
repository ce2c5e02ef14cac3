"""Registry of the engine's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelweave.plans import catalog_queries, density_queries, grid_queries, structure_queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures below the threshold, with size, mass, centroid, box and exposed area."""
    return grid_queries.stitched_catalog(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**grid_queries.QUERIES, **structure_queries.QUERIES, **density_queries.QUERIES, **catalog_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**grid_queries.SQL, **structure_queries.SQL, **density_queries.SQL, **catalog_queries.SQL}

"""Catalog tables and their metadata."""

from __future__ import annotations

import json
import subprocess
from dataclasses import asdict

from pyspark.sql import DataFrame

from voxelweave.config import EngineConfig


def git_revision() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def write_catalog(df: DataFrame, path: str, config: EngineConfig, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet under ``path/data`` and a one-row JSON table with the settings under ``path/meta``."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/data")
    meta = json.dumps({"config": asdict(config), "columns": df.columns, "git_rev": git_revision()})
    df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

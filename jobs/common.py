"""What the jobs share: settings from a file that Spark reads, a session for the command line, a log."""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import fields

from pyspark.sql import SparkSession

from voxelweave.scratch import shared_dir


def settings(spark: SparkSession, kind: type, path: str | None):
    """An instance of the dataclass ``kind`` from a JSON file (any store that Spark reads); its defaults without one.

    ``ValueError`` for a name it does not have.
    """
    values = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := sorted(set(values) - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**values)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one call, under the shared one."""
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def command_line_session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()

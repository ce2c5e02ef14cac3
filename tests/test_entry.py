"""The driver contract: names, SQL keys, agreement with SQL, and independence from the optional subpackage."""

import importlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

SMALL = Path("/root/testdata/sf0.01")


def test_keys():
    every, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(every) and len(every) > 60


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_works_in_a_copy_without_the_optional_folders(tmp_path, with_pipeline):
    root = Path(__spark_entry__.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "voxelweave", tmp_path / "voxelweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    if with_pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = (
        "import __spark_entry__ as e; names = e.queries(); assert e.__file__.startswith(__import__('os').getcwd()); "
        "assert 'stitched_catalog' in names and not any(n.startswith('op') or n == 'pipeline' for n in names); assert set(e.oracle_sql()) <= set(names)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_library_does_not_import_the_subpackage():
    root = Path(__spark_entry__.__file__).parent / "voxelweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "voxelweave.llm" not in p.read_text(), p


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["clump_cell_count_volume_mass", "interface_edges", "threshold_mask_gt_density", "size_spectrum", "cumulative_envelope", "run_name_parse", "neighbor_edges_18"])
def test_agrees_with_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for f in SMALL.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = __spark_entry__.queries()[name](spark, str(SMALL)).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    number = lambda v: None if pd.isna(v) else float(v) if not isinstance(v, (str, bool)) else v
    tidy = lambda df: sorted(repr([number(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False))
    assert tidy(got) == tidy(want)


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
def test_entry_rows(spark):
    df = __spark_entry__.entry(spark)
    assert {"gid", "cell_count", "area"} <= set(df.columns) and df.count() > 0
    assert "voxelweave" in sys.modules and importlib is not None

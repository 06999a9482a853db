"""Intermediate tables, and this package on the executors."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodekey.sources.written import new_path, shared_root, written  # noqa: F401

_PACKAGE_ROOT = Path(__file__).resolve().parents[2]

stage = written


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, unless it already is."""
    sc = spark.sparkContext
    inherited = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(_PACKAGE_ROOT) in inherited or getattr(sc, "_lodekey_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lodekey-")) / "lodekey_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((_PACKAGE_ROOT / "lodekey").rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE_ROOT))
    sc.addPyFile(str(target))
    sys.path[:] = [p for p in sys.path if p != str(target)]
    sc._lodekey_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Intermediate tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder.  It is set here only where the
session leaves it unset and everything runs on one machine, as in tests; on
a cluster a missing setting is an error, as executors can't see a driver's
local folder.  A written table cuts the lineage, so a lost executor costs a
re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="lodekey-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)

"""Cutting lineage: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver's script was started."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = ":".join([*parts, ROOT])
    return spark


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """df written to the shared folder and read again; a lost executor costs only a reread."""
    path = f"{shared_root(df.sparkSession)}/strata/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: a temporary one if all is one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strata_")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")

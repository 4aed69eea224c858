"""Resumable batches: what is left to do, what counts of several attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remaining(targets: DataFrame, done: DataFrame, key: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Targets that are neither done nor known to fail."""
    left = targets.join(done.select(*key), key, "left_anti")
    return left if failed is None else left.join(failed.select(*key), key, "left_anti")


def latest_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def split_outcomes(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that worked, and those with an error."""
    return encoded.where("error is null").drop("error"), encoded.where("error is not null")

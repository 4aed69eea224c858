"""The session that the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "strataspark", master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in more.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()

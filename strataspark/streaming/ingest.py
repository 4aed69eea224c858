"""The resumable steps as streams: what was seen is in the checkpoint, so a restart continues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def extract_stream(entities: DataFrame, targets: DataFrame, key: str = "qid") -> DataFrame:
    """Entities among the targets, each key once."""
    return entities.join(targets.select(key).distinct(), key, "left_semi").dropDuplicates([key])


def deduplicated(events: DataFrame, key: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once; keys older than the watermark are forgotten."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def once_each(events: DataFrame, key: list[str]) -> DataFrame:
    """Each key once and for good: keys are never forgotten, so the state grows with them. deduplicated() has a bounded state."""
    return events.dropDuplicates(key)


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window, closed when the watermark has passed."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    w = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()

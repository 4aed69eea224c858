"""Reading and writing the file formats of a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip

AUDIO = ("mp3", "wav", "flac", "ogg", "m4a", "aac")


def tsv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A table with a header, all text; what is missing is the empty string."""
    r = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = (r.schema(schema) if schema else r).csv(path)
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def ids(spark: SparkSession, path: str, column: str = "qid") -> DataFrame:
    """Ids that aren't blank."""
    return tsv(spark, path).select(py_strip(column).alias("qid")).where("qid <> ''")


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a (bz2) dump, one entity each: brackets and trailing commas go. Compressed blocks are read in parallel."""
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("value")).where("value not in ('[', ']', '')")


def entity_files(spark: SparkSession, path: str, glob: str = "Q*.json") -> DataFrame:
    """Whole JSON files below a folder, with their paths."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    out = r.select("value", F.col("_metadata.file_path").alias("path_order"))
    if out.isEmpty():
        raise FileNotFoundError(f"no {glob} below {path}")
    return out


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of saved API pages `qid/page*.json`, in page order: qid, pos, recording_id, download_url."""
    schema = "recordings array<struct<id:string,file:string>>"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "page*.json").option("multiLine", True).schema(schema).json(path).select("recordings", F.col("_metadata.file_path").alias("p"))
    x = raw.withColumn("qid", F.element_at(F.split("p", "/"), -2)).select("qid", "p", F.posexplode("recordings").alias("i", "r"))
    return x.select("qid", F.struct("p", "i").alias("pos"), F.col("r.id").alias("recording_id"), F.col("r.file").alias("download_url"))


def media_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = AUDIO) -> DataFrame:
    """Path and length of media files, without their content."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return d.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Title and the last revision's text of each page of an export."""
    schema = "title string, revision array<struct<text:string>>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).select("title", F.coalesce(F.element_at("revision", -1)["text"], F.lit("")).alias("wikitext"))


def run_registry(spark: SparkSession, path: str) -> DataFrame:
    """(modality, label, path) of a registry of selected runs."""
    df = spark.read.option("multiLine", True).schema("runs map<string,map<string,string>>").json(path)
    return df.select(F.explode("runs").alias("modality", "r")).select("modality", F.explode("r").alias("label", "path"))


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Committed as a whole by Spark's output protocol: readers see all of a write or nothing."""
    df.write.mode(mode).partitionBy(*by).parquet(path)

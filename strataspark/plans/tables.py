"""The driver's tables, and what stands in for a knowledge base in them: a taxonomy (root, regions, nations, customers and
suppliers), vectors with labels, names, recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, parent_taxon, en_name, taxon_name, taxon_rank_name, pos."""
    t = lambda n: read(spark, sf_dir, n)

    def part(df: DataFrame, p: str, key: str, up, name: str, rank: str, pos: int) -> DataFrame:
        return df.select(F.concat(F.lit(p), F.col(key)).alias("qid"), up.alias("parent_taxon"), F.col(name).alias("en_name"), F.lit("").alias("taxon_name"), F.lit(rank).alias("taxon_rank_name"), F.lit(pos).alias("pos"))

    root = spark.range(1).select(F.lit("ROOT").alias("qid"), F.lit("").alias("parent_taxon"), F.lit("Root").alias("en_name"), F.lit("").alias("taxon_name"), F.lit("class").alias("taxon_rank_name"), F.lit(0).alias("pos"))
    out = root.union(part(t("region"), "R", "r_regionkey", F.lit("ROOT"), "r_name", "order", 1))
    out = out.union(part(t("nation"), "N", "n_nationkey", F.concat(F.lit("R"), "n_regionkey"), "n_name", "family", 2))
    out = out.union(part(t("customer"), "C", "c_custkey", F.concat(F.lit("N"), "c_nationkey"), "c_name", "species", 3))
    return out.union(part(t("supplier"), "S", "s_suppkey", F.concat(F.lit("N"), "s_nationkey"), "s_name", "subspecies", 4))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, qid (the label), embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.concat(F.lit("L"), "label").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("qid"), F.col("p_name").alias("en_name"), F.to_json(F.array("p_brand", "p_name")).alias("en_aliases"), F.col("p_type").alias("enwiki_title"))


def pages_of_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities, parts as their recordings."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("recording_id"))

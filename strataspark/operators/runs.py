"""Embedding runs: which is current, what fits together, what is common to all."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, mean_by
from .recordings import first_seen


def latest(catalog: DataFrame, keys: list[str], tag: str = "run_tag") -> DataFrame:
    """The run with the largest tag (by text) of each key."""
    return catalog.groupBy(*keys).agg(F.max(tag).alias(tag))


def compatible(wanted: dict) -> Column:
    """Whether a run's metadata equal what is wanted; None only equals null."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def language_run(ids: DataFrame, manifest: DataFrame, default: str = "en") -> DataFrame:
    """(row_idx, surface_id, embedding) with the manifest's columns; of equal surface ids the last row counts; without a row the
    language is the default."""
    w = Window.partitionBy("surface_id").orderBy(F.desc("row_no"))
    one = manifest.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "row_no")
    return ids.join(one, "surface_id", "left").withColumn("language", F.coalesce("language", F.lit(default)))


def audio_run(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """Positions joined with the manifest; a blank window index is 0."""
    return ids.join(manifest, "row_idx").withColumn("window_index", F.coalesce(F.nullif(F.col("window_index").cast("string"), F.lit("")), F.lit("0")).cast("int"))


def first_vectors(df: DataFrame, order: list[str], key: str = "qid") -> DataFrame:
    return first_seen(df, [key], order)


def file_vectors(df: DataFrame) -> DataFrame:
    """The mean over a file's windows."""
    return mean_by(df, ["qid", "relative_path"], "embedding")


def representative_files(files: DataFrame, runs: int) -> DataFrame:
    """The smallest path of each entity among those that all runs have."""
    common = files.select("run", "qid", "relative_path").distinct().groupBy("qid", "relative_path").agg(F.count("*").alias("n")).where(F.col("n") == runs)
    return common.groupBy("qid").agg(F.min("relative_path").alias("relative_path"))


def complete_ids(members: DataFrame, runs: int) -> DataFrame:
    """Entities that all runs have."""
    return members.select("run", "qid").distinct().groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") == runs).select("qid")


def aligned(members: DataFrame, runs: int) -> DataFrame:
    return members.join(complete_ids(members, runs), "qid", "left_semi")


def summary(members: DataFrame) -> DataFrame:
    """Entities, rows and dimensions of each run."""
    size = F.size(doubles("embedding"))
    return members.groupBy("run").agg(F.countDistinct("qid").alias("qid_count"), F.count("*").alias("row_count"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))


def check_aligned(df: DataFrame) -> DataFrame:
    """One row: how many rows, and whether all vectors have one dimension."""
    size = F.size("embedding")
    return df.agg(F.count("*").alias("row_count"), (F.min(size) == F.max(size)).alias("one_dimension"))


def gathered(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """The vectors of a list of (pos, qid), in its order; of repeated ids in the store the last row counts."""
    w = Window.partitionBy("qid").orderBy(F.desc("row_idx"))
    last = store.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("qid", "embedding")
    return wanted.join(last, "qid").orderBy("pos")


def specs(bundles: dict[str, list[str]], patterns: list[str]) -> list[tuple[str, tuple[str, ...]]]:
    """For each pattern of letters (as GL) every choice of one run for each of its modalities, in the order G, L, A."""
    out = []
    for p in patterns:
        letters = [c for c in "GLA" if c in p.upper()]
        out += [("".join(letters), runs) for runs in product(*[sorted(bundles.get(c, [])) for c in letters])]
    return out

"""Stored embedding runs: folders of `qids.json`, `embeddings.npy`, `metadata.json` and a manifest, found by listing or named in a
registry, read as DataFrames with explicit positions. Paths go through Spark's readers and Hadoop's file systems only."""

from __future__ import annotations

import io
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, or_else, py_strip
from ..operators.runs import audio_run, file_vectors, first_vectors, language_run
from ..plans.staging import ready
from .files import tsv

MODALITIES = ("graph", "language", "audio")
#: How deep below a modality's folder its runs lie, and the files that make a folder one.
DEPTHS = {"graph": 2, "language": 1, "audio": 3}
REQUIRED = {"graph": ("embeddings.npy", "qids.json"), "language": ("embeddings.npy", "qids.json"), "audio": ("embeddings.npy", "qids.json", "audio_manifest.tsv")}


@dataclass(frozen=True)
class Run:
    modality: str
    label: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.modality}__{self.label}"


# ---- listing


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, by name."""
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or ())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def latest_dir(spark: SparkSession, root: str, needed: tuple[str, ...] = ()) -> str:
    """The folder below root whose name sorts last, of those that hold the needed files."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        raise FileNotFoundError(root)
    found = [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()]
    found = [d for d in found if all(exists(spark, f"{d}/{n}") for n in needed)]
    if not found:
        raise FileNotFoundError(f"no runs below {root}")
    return max(found, key=lambda d: d.rsplit("/", 1)[-1])


def discover(spark: SparkSession, root: str, modality: str) -> list[Run]:
    """The runs of a modality below root; the label is made of the folders' names."""
    depth = DEPTHS[modality]
    out = []
    for d in matching(spark, f"{root.rstrip('/')}/{modality}/{'/'.join('*' * depth)}"):
        if all(exists(spark, f"{d}/{n}") for n in REQUIRED[modality]):
            out.append(Run(modality, "__".join(d.split("/")[-depth:]), d))
    return out


def discover_all(spark: SparkSession, root: str) -> list[Run]:
    return [r for m in MODALITIES for r in discover(spark, root, m)]


def read_json(spark: SparkSession, path: str):
    """A small JSON file, on the driver."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def registry(spark: SparkSession, path: str, base: str) -> list[Run]:
    """The runs that a registry names, modality by modality; relative paths lie below base."""
    got = read_json(spark, path)
    runs = got.get("runs", {}) if isinstance(got, dict) else None
    if not isinstance(runs, dict) or not all(isinstance(runs.get(m, {}), dict) for m in MODALITIES):
        raise ValueError("a registry is an object whose `runs` holds an object for each modality")
    full = lambda p: p if p.startswith("/") or "://" in p else f"{base.rstrip('/')}/{p}"
    return [Run(m, str(label), full(str(p))) for m in MODALITIES for label, p in runs.get(m, {}).items()]


# ---- parts of a run


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, value) of a JSON list, or of the list under `qids`, stripped."""
    raw = spark.read.text(path, wholetext=True)
    lists = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "struct<qids:array<string>>")["qids"])
    if raw.where(lists.isNotNull()).isEmpty():
        raise ValueError(f"neither a list nor an object with one: {path}")
    return raw.select(F.posexplode(lists).alias("row_idx", "v")).select("row_idx", py_strip("v").alias("value"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, embedding) of a .npy file of up to 2 GB, from any store that Spark reads."""
    ready(spark)

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                m = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
                if m.ndim != 2:
                    raise ValueError("a matrix has two dimensions")
                for at in range(0, len(m), 4096):
                    part = np.ascontiguousarray(m[at : at + 4096], np.float32)
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))], ["row_idx", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_idx int, embedding array<float>")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with row_idx, the position in its file. Manifests are one file; rows keep its order."""
    t = tsv(spark, path).coalesce(1)
    return t.withColumn("row_idx", F.monotonically_increasing_id().cast("int"))


def same_length(*parts: tuple[str, DataFrame]) -> int:
    """How many rows all parts have; an error if they differ."""
    n = {name: df.count() for name, df in parts}
    if len(set(n.values())) > 1:
        raise ValueError("rows differ: " + ", ".join(f"{k} {v}" for k, v in n.items()))
    return next(iter(n.values()))


# ---- runs


def graph_run(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, qid, embedding."""
    ids, m = id_list(spark, f"{path}/qids.json").withColumnRenamed("value", "qid"), matrix(spark, f"{path}/embeddings.npy")
    same_length(("qids", ids), ("embeddings", m))
    return ids.join(m, "row_idx")


def audio_rows(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, audio_id, qid, window_index, embedding and the manifest's other columns; ids that the manifest leaves blank come
    from the lists."""
    rows, m = numbered(spark, f"{path}/audio_manifest.tsv"), matrix(spark, f"{path}/embeddings.npy")
    same_length(("manifest", rows), ("embeddings", m))
    for name in ("audio_id", "qid"):
        listed = id_list(spark, f"{path}/{name}s.json").select("row_idx", F.col("value").alias("__listed"))
        own = F.col(name) if name in rows.columns else F.lit("")
        rows = rows.join(listed, "row_idx", "left").withColumn(name, F.when(F.col("__listed").isNotNull(), py_strip(or_else(own, F.col("__listed")))).otherwise("")).drop("__listed")
    if "window_index" not in rows.columns:
        rows = rows.withColumn("window_index", F.lit(""))
    return audio_run(m, rows)


def language_rows(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, surface_id, qid, language, surface_text, source, embedding and what else the manifest has, which may be missing."""
    ids = id_list(spark, f"{path}/surface_ids.json").withColumnRenamed("value", "surface_id").join(id_list(spark, f"{path}/qids.json").withColumnRenamed("value", "qid"), "row_idx")
    m = matrix(spark, f"{path}/embeddings.npy")
    same_length(("ids", ids), ("embeddings", m))
    language = str(read_json(spark, f"{path}/metadata.json").get("language") or "en")
    rows = ids.join(m, "row_idx")
    if not exists(spark, f"{path}/surface_manifest.tsv"):
        return rows.select("*", F.lit(language).alias("language"), F.lit("").alias("surface_text"), F.lit("").alias("source"))
    manifest = numbered(spark, f"{path}/surface_manifest.tsv").withColumnRenamed("row_idx", "row_no").withColumn("surface_id", py_strip("surface_id"))
    manifest = manifest.withColumn("language", F.nullif("language", F.lit(""))).drop("qid")
    out = language_run(rows, manifest, language)
    return out.withColumns({c: blank(c) for c in ("surface_text", "source") if c in out.columns})


def bundle(spark: SparkSession, run: Run) -> DataFrame:
    """modality (a letter), label, qid, source_id, pos, embedding: an entity's vectors in their defined order, blank ids left out."""
    if run.modality == "graph":
        t = graph_run(spark, run.path).select("qid", F.col("qid").alias("source_id"), F.struct("row_idx").alias("pos"), "embedding")
    elif run.modality == "language":
        rows = graph_run(spark, run.path)
        manifest = numbered(spark, f"{run.path}/surface_manifest.tsv") if exists(spark, f"{run.path}/surface_manifest.tsv") else None
        if manifest is not None and manifest.count() == rows.count():
            # an ordinal that is no number counts as the row's position
            of = manifest.select("row_idx", F.coalesce(F.expr("try_cast(ordinal as int)"), F.col("row_idx")).alias("ordinal"), "surface_id")
            t = rows.join(of, "row_idx").select("qid", F.col("surface_id").alias("source_id"), F.struct("ordinal", "surface_id", "row_idx").alias("pos"), "embedding")
        else:
            t = rows.select("qid", F.col("row_idx").cast("string").alias("source_id"), F.struct("row_idx").alias("pos"), "embedding")
    else:
        rows = audio_rows(spark, run.path).withColumn("relative_path", py_strip("relative_path")).where("relative_path <> '' and qid <> ''")
        t = file_vectors(rows.select("qid", "relative_path", "embedding")).select("qid", F.col("relative_path").alias("source_id"), F.struct("relative_path").alias("pos"), "embedding")
    w = Window.partitionBy("qid").orderBy("pos")
    t = t.where("qid <> ''").withColumn("pos", F.row_number().over(w) - 1)
    return t.select(F.lit(run.modality[0].upper()).alias("modality"), F.lit(run.label).alias("label"), "qid", "source_id", "pos", F.col("embedding").cast("array<double>").alias("embedding"))


def bundles(spark: SparkSession, runs: list[Run], labels: dict[str, set[str] | None] | None = None) -> DataFrame:
    """The bundles of all runs, or of those with certain labels for a modality, in one table."""
    chosen = [r for r in sorted(runs, key=lambda r: (r.modality, r.label)) if (labels or {}).get(r.modality) is None or r.label in labels[r.modality]]
    if not chosen:
        raise ValueError("no run is left")
    out = bundle(spark, chosen[0])
    for r in chosen[1:]:
        out = out.union(bundle(spark, r))
    return out


def vector_maps(vectors: DataFrame, representative: DataFrame | None = None) -> DataFrame:
    """(modality, label, qid, embedding): the first vector of each entity in a run; audio only by its representative file."""
    if representative is not None:
        chosen = representative.select("qid", F.col("relative_path").alias("source_id"))
        vectors = vectors.where("modality <> 'A'").unionByName(vectors.where("modality = 'A'").join(chosen, ["qid", "source_id"], "left_semi").select(vectors.columns))
    return first_vectors(vectors.withColumn("run", F.struct("modality", "label", "qid")), ["pos"], "run").select("modality", "label", "qid", "embedding")


def inspected(vectors: DataFrame) -> DataFrame:
    """Entities, rows and dimension of each run."""
    return vectors.groupBy("modality", "label").agg(F.countDistinct("qid").alias("qid_count"), F.count("*").alias("row_count"), F.max(F.size("embedding")).alias("dim"))

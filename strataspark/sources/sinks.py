"""Writers: replacement as a whole, rows that aren't there yet, upserts, and the artifacts of runs and reports."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..operators.entity import sharded
from ..plans.staging import staged
from .files import write_tsv
from .stores import _fs, exists

# ---- how tables are written


def swap(spark: SparkSession, made: str, path: str) -> None:
    """Puts what has been written in the place of path: readers see the old or the new, but for the moment between two renames."""
    fs, new = _fs(spark, made)
    _, old = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")
    fs.mkdirs(old.getParent())
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"{made} can't be moved to {path}")
    fs.delete(aside, True)


def replaced(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Writes beside path first; a failure leaves what was there."""
    made = f"{path}.new-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(made)
    swap(df.sparkSession, made, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file as a whole."""
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    made = f"{path}.new-{uuid.uuid4().hex}"
    fs, p = _fs(spark, made)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    swap(spark, made, path)


def write_json(spark: SparkSession, path: str, content) -> None:
    write_text(spark, path, json.dumps(content, ensure_ascii=False, indent=2, sort_keys=True))


def append_missing(df: DataFrame, path: str, key: list[str], partition: list[str] | None = None) -> DataFrame:
    """Appends the rows whose key the table doesn't hold yet, the first of each, and returns them as they are in the table afterwards."""
    spark = df.sparkSession
    w = Window.partitionBy(*key).orderBy(F.xxhash64(*df.columns))
    new = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti").select(df.columns)
    out = new.write.mode("append")
    (out.partitionBy(*partition) if partition else out).parquet(path)
    return spark.read.parquet(path)


def shard_entities(entities: DataFrame, path: str, qid: str = "qid") -> DataFrame:
    """Entities below the folders of their first two digits; those on file are left as they are."""
    return append_missing(sharded(entities, qid), path, [qid], ["d1", "d2"])


def upsert(df: DataFrame, path: str, key: list[str], order: Column | None = None) -> None:
    """Rows of df replace those with the same key; of equal keys in df the last by `order` counts."""
    spark = df.sparkSession
    if order is not None:
        w = Window.partitionBy(*key).orderBy(order.desc())
        df = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    if exists(spark, path):
        df = spark.read.parquet(path).join(df.select(*key), key, "left_anti").unionByName(df)
    replaced(df, path)


def delete_cascade(nodes: str, edges: str, gone: DataFrame) -> None:
    """Takes nodes out of their table, and the edges at them out of theirs."""
    spark = gone.sparkSession
    ids = staged(gone.select("qid"))  # it may read what is replaced here
    replaced(spark.read.parquet(nodes).join(ids, "qid", "left_anti"), nodes)
    e = spark.read.parquet(edges)
    columns = e.columns
    for end in ("parent_qid", "child_qid"):
        e = e.join(ids.withColumnRenamed("qid", end), end, "left_anti").select(columns)
    replaced(e, edges)


# ---- stores


def write_ontology(rows: DataFrame, path: str) -> None:
    """Sorted by qid, over files too."""
    replaced(rows.orderBy("qid"), path)


def read_ontology(spark: SparkSession, path: str, key: str = "qid") -> DataFrame:
    df = spark.read.parquet(path)
    if key not in df.columns:
        raise ValueError(f"no ontology: {path} has no column {key}")
    return df


def write_graph(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, root: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("metadata", metadata)):
        replaced(df, f"{root}/{name}")


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; an error if either isn't what a graph consists of."""
    nodes, edges = (spark.read.parquet(f"{root}/{n}") for n in ("nodes", "edges"))
    if "qid" not in nodes.columns or not {"parent_qid", "child_qid"} <= set(edges.columns):
        raise ValueError(f"no graph: {root}")
    return nodes, edges


def utc_stamp(kind: str = "iso", now: datetime | None = None) -> str:
    """iso: seconds with an offset; tag: month, day, hour and minute; folder: for names."""
    now = now or datetime.now(timezone.utc)
    return {"iso": now.replace(microsecond=0).isoformat(), "tag": now.strftime("%m%d%H%M"), "folder": now.strftime("%Y%m%dT%H%M%SZ")}[kind]


def write_graph_run(vectors: DataFrame, trace: DataFrame | None, metadata: dict, path: str) -> None:
    """vectors, the training trace and a summary of a graph embedding."""
    replaced(vectors.orderBy("qid"), f"{path}/vectors")
    if trace is not None:
        replaced(trace.orderBy("epoch").coalesce(1), f"{path}/trace", "csv", header="true")
    size = F.size("embedding")
    n, dim = vectors.agg(F.count("*"), F.max(size)).first()
    write_json(vectors.sparkSession, f"{path}/metadata.json", {"created_at_utc": utc_stamp(), **metadata, "node_count": n, "dim": dim})


def write_audio_batch(rows: DataFrame, path: str, batch: int | str) -> None:
    """A batch's vectors as a partition of their own: what is written stays, whatever happens to later batches."""
    replaced(rows, f"{path}/batch={batch}")


def write_surfaces(manifest: DataFrame, surfaces: DataFrame, path: str) -> None:
    """The manifest by language, and each entity's surfaces."""
    manifest.write.mode("overwrite").partitionBy("language").parquet(f"{path}/manifest")
    replaced(surfaces, f"{path}/qid_to_surfaces", "json")


METRICS = ["nmi", "ari", "purity", "homogeneity", "completeness", "v_measure", "silhouette"]


def report_markdown(rows: list[dict], label_field: str, graph: str, root: str) -> str:
    """A table of clustering metrics by method, best mean rank first as given."""
    head = ["method", *METRICS, "mean_rank"]
    out = ["# Graph Clustering Report", "", f"- Graph: `{graph}`", f"- Embeddings root: `{root}`", f"- Label field: `{label_field}`", "", "## Summary", ""]
    out += ["| " + " | ".join(head) + " |", "| --- |" + " ---: |" * (len(head) - 1)]
    out += ["| " + " | ".join([str(r["method"]), *(f"{r[m]:.4f}" for m in METRICS), f"{r['mean_rank']:.2f}"]) + " |" for r in rows]
    notes = ["Labels are used only for evaluation.", "Clustering uses k-means with k equal to the number of unique true labels.", "Silhouette is computed on a bounded sample when the embedding set is large."]
    return "\n".join([*out, "", "## Notes", "", *(f"- {n}" for n in notes)]) + "\n"


def write_cluster_report(ranks: DataFrame, assignments: dict[str, DataFrame], path: str, label_field: str, graph: str, root: str) -> None:
    """A row for each method, as table, JSON and text, and each method's assignments (qid, true_label, cluster_id)."""
    spark = ranks.sparkSession
    rows = [r.asDict() for r in ranks.orderBy("mean_rank", "method").collect()]  # one for each method
    write_json(spark, f"{path}/report.json", {"label_field": label_field, "summary": rows})
    write_text(spark, f"{path}/report.md", report_markdown(rows, label_field, graph, root))
    replaced(ranks.orderBy("mean_rank", "method").coalesce(1), f"{path}/summary", "csv", header="true")
    for method, df in assignments.items():
        replaced(df.select("qid", "true_label", "cluster_id").orderBy("qid"), f"{path}/{method}_assignments", "csv", sep="\t", header="true")


PREDICTIONS = ["sample_id", "qid", "split", "target_rank", "true_label", "predicted_label", "modality_pattern"]


def write_evaluation(predictions: DataFrame, metrics: DataFrame, path: str, config: dict | None = None) -> None:
    """Predictions by row, and split, row_count, accuracy and macro_f1 with six decimals."""
    replaced(predictions.select(*PREDICTIONS), f"{path}/predictions", "csv", sep="\t", header="true")
    six = [fixed(F.col(c), 6).alias(c) for c in ("accuracy", "macro_f1")]
    replaced(metrics.select("split", "row_count", *six).coalesce(1), f"{path}/metrics", "csv", sep="\t", header="true")
    if config is not None:
        write_json(predictions.sparkSession, f"{path}/config.json", config)


def write_repair_report(report: DataFrame, counts: DataFrame, path: str) -> None:
    write_tsv(report, f"{path}/repair_report")
    write_json(report.sparkSession, f"{path}/repair_summary.json", counts.first().asDict())


def write_wiki(manifest: DataFrame, texts: DataFrame, path: str) -> None:
    """The manifest, and the texts as rows of (qid, text)."""
    write_tsv(manifest, f"{path}/manifest")
    replaced(texts.select("qid", "text"), f"{path}/texts")


def write_similarity(pairs: DataFrame, histogram: DataFrame, ids: DataFrame, path: str) -> None:
    """A similarity matrix as its pairs, its histogram and the ids of its rows."""
    for name, df in (("pairs", pairs), ("histogram", histogram), ("ids", ids)):
        replaced(df, f"{path}/{name}")


RETRIEVAL = ["mAP", "MRR", "nDCG@10", "nDCG@50", "nDCG@100"]


def write_retrieval(runs: DataFrame, per_query: DataFrame | None, path: str, metadata: dict) -> None:
    """A row for each run with ten decimals, if wanted one for each query, and what was run."""
    ten = [fixed(F.col(f"`{c}`"), 10).alias(c) for c in RETRIEVAL]
    replaced(runs.select("run_name", "modalities", "run_labels", "sample_count", "query_count", "evaluated_query_count", *ten).coalesce(1), f"{path}/metrics", "csv", sep="\t", header="true")
    if per_query is not None:
        ten = [fixed(F.col(f"`{c}`"), 10).alias(c) for c in ("average_precision", "reciprocal_rank", *RETRIEVAL[2:])]
        replaced(per_query.select("qid", "sample_id", "relevant_count", *ten), f"{path}/per_query", "csv", sep="\t", header="true")
    write_json(runs.sparkSession, f"{path}/metadata.json", metadata)

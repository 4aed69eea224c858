"""A corpus pipeline: quality, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents, and further columns of docs, whatever they are called, stay as they are. Null and empty texts pass
every stage but the first, which judges them like others. Rows that repeat an id or a text are each judged for themselves, but
where near-duplicates are removed. Ties don't matter: no stage ranks rows. Texts of any length are worked on whole. Empty tables
give empty tables, and without labels or benchmark items nothing is removed by these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import bpe, decontam, minhash, quality, secrets
from strataspark.llm.common import cut, discard, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from `labels`, but for the held-out fold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "__score")
    return quality.score(docs, model, out_col=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; of rows that repeat id and text, one. An id
    goes only if all its rows do."""
    found = cut(minhash.near_duplicates(docs, words=5, percent=80).select("doc_id", "kept"), "near")
    by_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = by_id.where("not kept").select("doc_id")
    counts = by_id.agg(F.count_if(~F.col("kept")), F.max("n")).first()
    if counts[0] <= minhash.SMALL_IDS:
        gone = F.broadcast(gone)
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # found is read until the result is written; run() removes the folder of its own tables only
    return out.dropDuplicates(["doc_id", "text"]) if (counts[1] or 0) > 1 else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of `benchmark`, or a slightly changed one, go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    out = secrets.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    out = bpe.round_trip(docs)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", tokens_stage),
]
#: Models, sketches and tokenizers have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
        if last is not None:
            discard(last)
        last = docs
    return docs

"""Recordings of entities: maps from pages, caps, reconciliation with files and audits, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, file_type, or_else, py_strip, recording_url


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def recording_map(pages: DataFrame, species: DataFrame | None = None) -> DataFrame:
    """From (qid, pos, recording_id, download_url[, species]): one row for each id with its recordings in the order first
    seen, as parallel lists. A blank URL is the default one; a blank species is filled from `species`."""
    one = first_seen(pages.withColumn("recording_id", py_strip("recording_id")).where("recording_id <> ''"), ["qid", "recording_id"], ["pos"])
    url = or_else(F.col("download_url"), recording_url(F.col("recording_id"))) if "download_url" in pages.columns else recording_url(F.col("recording_id"))
    got = one.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "recording_id", url.alias("url")))).alias("r"))
    out = got.select("qid", F.size("r").alias("recording_count"), F.transform("r", lambda x: x["recording_id"]).alias("recording_ids"), F.transform("r", lambda x: x["url"]).alias("download_urls"))
    if species is not None:
        out = out.join(species.select("qid", "xeno_canto_species_id"), "qid", "left").withColumn("xeno_canto_species_id", blank("xeno_canto_species_id"))
    return out


def capped(maps: DataFrame, limit: int = 20) -> DataFrame:
    """At most `limit` recordings for each id, the first ones."""
    return maps.withColumn("recording_ids", F.slice("recording_ids", 1, limit)).withColumn("download_urls", F.slice("download_urls", 1, limit))


def index(maps: DataFrame) -> DataFrame:
    """(qid, recording_id, download_url, file_type): lists side by side; of equal keys the last."""
    flat = maps.select("qid", "download_urls", F.posexplode("recording_ids").alias("pos", "recording_id"))
    url = or_else(F.get("download_urls", F.col("pos")), recording_url(F.col("recording_id")))
    w = Window.partitionBy("qid", "recording_id").orderBy(F.desc("pos"))
    return flat.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("qid", "recording_id", url.alias("download_url"), file_type(url, F.lit("")).alias("file_type"))


def to_fetch(maps: DataFrame, existing: DataFrame, limit: int = 20) -> DataFrame:
    """Recordings that no file exists for yet."""
    return index(capped(maps, limit)).join(existing.select("qid", "recording_id"), ["qid", "recording_id"], "left_anti")


def files(paths: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """Id and recording of each file `id/recording.suffix`; temporary and shallow ones are left out."""
    p = F.split(path_col, "/")
    return paths.where((F.size(p) >= 2) & ~F.endswith(F.lower(path_col), F.lit(".tmp"))).withColumn("qid", F.element_at(p, 1)).withColumn("recording_id", F.regexp_replace(F.element_at(p, -1), r"(?<=.)\.[^.]*$", ""))


def backfilled(audio: DataFrame, idx: DataFrame) -> DataFrame:
    """Files with what the recording index knows of them; blank where it doesn't."""
    cols = [c for c in idx.columns if c not in ("qid", "recording_id")]
    return audio.join(idx, ["qid", "recording_id"], "left").withColumns({c: blank(c) for c in cols})


# ---- audits

GOOD = ("valid", "repaired")


def audit_status(decodes: Column, attempted: Column, repaired: Column) -> Column:
    return F.when(decodes, "valid").when(attempted & repaired, "repaired").when(attempted, "repair_failed").otherwise("invalid")


def audit_counts(report: DataFrame) -> DataFrame:
    """valid, invalid (all that weren't valid at first), repaired, failed."""
    s = F.col("status")
    return report.agg(F.count_if(s == "valid").alias("valid"), F.count_if(s != "valid").alias("invalid"), F.count_if(s == "repaired").alias("repaired"), F.count_if(s.isin("invalid", "repair_failed")).alias("failed"))


def split_by_audit(examples: DataFrame, report: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Examples to keep, and those whose audit status is set and neither valid nor repaired."""
    bad = report.where((blank("status") != "") & ~F.col("status").isin(*GOOD)).select(*keys).distinct()
    return examples.join(bad, keys, "left_anti"), examples.join(bad, keys, "left_semi")


# ---- folds and splits, by hashes that any engine can repeat


def hash_order(*cols: Column | str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def fold_assignment(examples: DataFrame, entity: str, item: str, k: int = 5, seed: int = 0) -> DataFrame:
    """fold_index: shuffled position within the entity modulo k; entities with one example have none and only train."""
    w = Window.partitionBy(entity)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(hash_order(entity, item, seed=seed), item)) - 1
    out = examples.withColumn("__n", n).withColumn("__at", at)
    return out.withColumn("train_only", F.col("__n") == 1).withColumn("fold_index", F.when(F.col("__n") > 1, (F.col("__at") % k).cast("int"))).drop("__n", "__at")


def fold_splits(folds: DataFrame, k: int = 5) -> DataFrame:
    """Every example once for each fold: `test` in its own, `train` in the others."""
    each = folds.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.withColumn("split", F.when(F.coalesce(F.col("fold_index") == F.col("fold"), F.lit(False)), "test").otherwise("train"))


def entity_split(ids: DataFrame, entity: str, validation: float, test: float, seed: int = 0) -> DataFrame:
    """(entity, split): ids in the order of a hash; counts round half to even; test first, then validation, the rest trains.
    Positions come from counts of hash prefixes, so the order is never one task's work."""
    h = ids.select(F.col(entity).alias("id")).distinct().withColumn("h", hash_order("id", seed=seed)).withColumn("bin", F.substring("h", 1, 3))
    sizes = h.groupBy("bin").agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")  # of at most 4096 rows
    before = sizes.select("bin", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = h.join(F.broadcast(before), "bin").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("h", "id")))
    n_test = F.least(F.bround(F.col("total") * test), F.col("total"))
    n_val = F.least(F.bround(F.col("total") * validation), F.col("total") - n_test)
    return at.select(F.col("id").alias(entity), F.when(F.col("at") <= n_test, "test").when(F.col("at") <= n_test + n_val, "validation").otherwise("train").alias("split"))

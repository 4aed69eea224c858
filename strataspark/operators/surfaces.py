"""Names in several languages: candidates, ordinals, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_list, py_strip


def candidates(rows: DataFrame, name: str, aliases: str, title: str, sources: tuple[str, str, str], language: str, qid: str = "qid") -> DataFrame:
    """Name (source_index 0), aliases (1, 2, ...) and title (after these), blank ones left out. aliases: a JSON array or text."""
    a = alias_list(aliases)
    item = lambda text, source, i: F.struct(text.alias("surface_text"), F.lit(source).alias("source"), i.cast("int").alias("source_index"))
    every = F.concat(
        F.array(item(py_strip(name), sources[0], F.lit(0))), F.transform(a, lambda x, i: item(x, sources[1], i + 1)), F.array(item(py_strip(title), sources[2], F.size(a) + 1))
    )
    return rows.select(F.col(qid).alias("qid"), F.lit(language).alias("language"), F.explode(every).alias("x")).select("qid", "language", "x.*").where("surface_text <> '' and qid <> ''")


def ordinals(found: DataFrame) -> DataFrame:
    """0, 1, ... by text, source and index within an id and language; and the surface's id. Duplicates stay."""
    w = Window.partitionBy("qid", "language").orderBy("surface_text", "source", "source_index")
    out = found.withColumn("ordinal", F.row_number().over(w) - 1)
    return out.withColumn("surface_id", F.concat_ws("_", "qid", "language", "ordinal"))


def by_entity(manifest: DataFrame) -> DataFrame:
    """Each id's surfaces as a list of structs, by ordinal."""
    return manifest.groupBy("qid", "language").agg(F.array_sort(F.collect_list(F.struct("ordinal", "surface_id", "surface_text", "source", "source_index"))).alias("surfaces"))


def source_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("language", "source").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("qids"))

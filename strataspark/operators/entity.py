"""Semi-structured entities (JSON, in the dump's or the REST dialect) to ontology rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, py_strip, wiki_url
from ..plans.staging import staged
from .graph import closure, paths

_CLAIM = "array<struct<mainsnak:struct<datavalue:struct<value:string>>,value:struct<type:string,content:string>>>"
#: Labels and aliases hold strings or objects; as strings, objects come as their JSON.
_FIELDS = {
    "id": "string", "type": "string", "labels": "map<string,string>", "aliases": "map<string,array<string>>", "claims": f"map<string,{_CLAIM}>",
    "statements": f"map<string,{_CLAIM}>", "sitelinks": "map<string,struct<title:string>>",
}
ENTITY = "struct<" + ",".join(f"{k}:{v}" for k, v in _FIELDS.items()) + ">"


def parse(df: DataFrame, text_col: str = "value") -> DataFrame:
    """A column `entity`: a bare entity (with id and type), or the first of `entities`. Lines of a dump may end in a comma and
    be brackets only; what is no entity is left out."""
    line = F.regexp_replace(F.trim(F.col(text_col)), r",\s*$", "")
    bare = F.from_json(line, ENTITY)
    inner = F.get(F.map_values(F.from_json(F.get_json_object(line, "$.entities"), f"map<string,{ENTITY}>")), 0)
    ok = (F.coalesce(bare["id"], F.lit("")) != "") & (F.coalesce(bare["type"], F.lit("")) != "")
    return df.withColumn("entity", F.when(ok, bare).otherwise(inner)).where("entity.id is not null")


def _text(x: Column) -> Column:
    """A string as it is, of an object its `value`."""
    return F.coalesce(F.when(F.startswith(F.trim(x), F.lit("{")), F.get_json_object(x, "$.value")), x, F.lit(""))


def label(e: Column, lang: str) -> Column:
    return _text(F.try_element_at(e["labels"], F.lit(lang)))


def aliases_json(e: Column, lang: str) -> Column:
    got = F.transform(F.coalesce(F.try_element_at(e["aliases"], F.lit(lang)), F.array().cast("array<string>")), _text)
    return F.to_json(F.filter(got, lambda x: x != ""))


def claim_values(e: Column, prop: str) -> Column:
    """The values of a property's claims that aren't empty, `claims` before `statements`."""
    claims = F.coalesce(F.try_element_at(e["claims"], F.lit(prop)), F.try_element_at(e["statements"], F.lit(prop)))
    raw = lambda c: F.coalesce(c["mainsnak"]["datavalue"]["value"], F.when(c["value"]["type"] == "value", c["value"]["content"]))
    return F.filter(F.transform(F.coalesce(claims, F.array().cast(_CLAIM)), raw), lambda x: x.isNotNull() & (x != ""))


def claim_string(e: Column, prop: str) -> Column:
    first = F.get(claim_values(e, prop), 0)
    return F.when(F.startswith(first, F.lit("{")), F.lit("")).otherwise(F.coalesce(first, F.lit("")))


def claim_entity(e: Column, prop: str) -> Column:
    """The id that the first claim names."""
    first = F.get(claim_values(e, prop), 0)
    return F.coalesce(F.get_json_object(first, "$.id"), F.when(first.rlike("^Q[0-9]+$"), first), F.lit(""))


def image_names(e: Column) -> Column:
    return F.to_json(F.filter(claim_values(e, "P18"), lambda x: ~F.startswith(x, F.lit("{"))))


def sitelink(e: Column, site: str) -> Column:
    return F.coalesce(F.try_element_at(e["sitelinks"], F.lit(site))["title"], F.lit(""))


def ontology(entities: DataFrame, root: str | None = None) -> DataFrame:
    """The table of 19 columns, and `path` if a root is named, ordered by nothing; of entities with one id the last by `path_order` counts."""
    e = F.col("entity")
    if "path_order" in entities.columns:
        w = Window.partitionBy("entity.id").orderBy(F.desc("path_order"))
        entities = entities.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    rows = entities.select(
        e["id"].alias("qid"), F.concat(F.lit("https://www.wikidata.org/entity/"), e["id"]).alias("entity_url"), label(e, "en").alias("en_name"), label(e, "ja").alias("ja_name"),
        aliases_json(e, "en").alias("en_aliases"), aliases_json(e, "ja").alias("ja_aliases"), image_names(e).alias("img_names"), claim_string(e, "P2426").alias("xeno_canto_species_id"),
        claim_string(e, "P225").alias("taxon_name"), claim_entity(e, "P105").alias("taxon_rank"), claim_entity(e, "P171").alias("parent_taxon"), sitelink(e, "enwiki").alias("enwiki_title"), sitelink(e, "jawiki").alias("jawiki_title"),
    )
    rows = staged(rows, "entities")  # parsed once, read three times
    names = rows.select(F.col("qid").alias("k"), F.col("en_name").alias("ke"), F.col("ja_name").alias("kj"))
    for col, to in (("taxon_rank", "taxon_rank"), ("parent_taxon", "parent_taxon")):
        rows = rows.join(names, F.col(col) == F.col("k"), "left").withColumn(f"{to}_name", blank("ke")).withColumn(f"{to}_ja_name", blank("kj")).drop("k", "ke", "kj")
    if root is not None:
        rows = rows.join(paths(rows, closure(rows), root), "qid")
    return rows.withColumn("enwiki_url", wiki_url(F.lit("en"), F.col("enwiki_title"))).withColumn("jawiki_url", wiki_url(F.lit("ja"), F.col("jawiki_title")))


def species_ids(rows: DataFrame) -> DataFrame:
    """(qid, xeno_canto_species_id) of rows where both aren't blank; `id` stands in for a blank qid."""
    q = F.coalesce(F.nullif(py_strip("qid"), F.lit("")), py_strip("id")) if "id" in rows.columns else py_strip("qid")
    return rows.select(q.alias("qid"), py_strip("xeno_canto_species_id").alias("xeno_canto_species_id")).where("qid <> '' and xeno_canto_species_id <> ''")


def extract(dump: DataFrame, targets: DataFrame, done: DataFrame | None = None, key: str = "qid") -> tuple[DataFrame, DataFrame]:
    """The dump's rows among the targets that aren't done yet; and the targets that neither has."""
    left = targets.select(key).distinct()
    if done is not None:
        left = left.join(done.select(key), key, "left_anti")
    return dump.join(left, key, "left_semi"), left.join(dump.select(key), key, "left_anti")


def sharded(df: DataFrame, qid: str = "qid") -> DataFrame:
    """With the folders that an id is filed under: its first and second digit (0, if it has none)."""
    digits = F.regexp_extract(qid, r"^Q([0-9]+)$", 1)
    at = lambda i: F.coalesce(F.nullif(F.substring(digits, i, 1), F.lit("")), F.lit("0"))
    return df.withColumn("d1", at(1)).withColumn("d2", at(2))

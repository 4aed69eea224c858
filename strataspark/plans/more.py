"""Further queries of the catalog: lists and manifests, readers and writers by way of files in the shared folder, draws, encoders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import classify, embedders, embedding, entity, graph, manifests, recordings, runs, signals, similarity, surfaces
from ..sources import files, sinks, stores
from ..streaming import ingest
from .catalog import _CL, _NAMES, _SIM, TAX, UP, VEC, _names, _tax, query
from .staging import ready, shared_root
from .tables import read, tax_rows, vectors


def folder(s: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what a query writes and reads back."""
    return f"{shared_root(s)}/strata/files/{name}-{uuid.uuid4().hex}"


# ---- lists and manifests


@query("qid_list_root", "WITH x AS (SELECT regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS qid, min(page_id) AS pos FROM pages GROUP BY 1) SELECT 'ROOT' AS qid, -1 AS pos UNION ALL SELECT qid, pos FROM x WHERE qid <> ''")
def qid_list_root(s, d):
    return manifests.id_list(read(s, d, "pages"), "url", "page_id", "ROOT")


_SPECIES = "c AS (SELECT 'C' || c_custkey AS qid, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE lower(c_mktsegment) END AS xeno_canto_species_id FROM customer UNION ALL SELECT 'N' || n_nationkey, lower(n_name) FROM nation)"


def _species(s, d):
    c = read(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("qid"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.lower("c_mktsegment")).alias("xeno_canto_species_id"))
    return c.union(read(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.lower("n_name")))


@query("leaf_targets", f"WITH {_SPECIES}, {TAX} SELECT * FROM c WHERE trim(xeno_canto_species_id) <> '' AND qid IN (SELECT qid FROM tax) AND qid NOT IN (SELECT parent_qid FROM edges)")
def leaf_targets(s, d):
    return manifests.leaf_targets(_species(s, d), *_tax(s, d))


@query("leaf_ontology", f"WITH {_SPECIES}, {TAX} SELECT t.qid, c.xeno_canto_species_id FROM tax t LEFT JOIN c USING (qid) WHERE t.qid NOT IN (SELECT parent_qid FROM edges)")
def leaf_ontology(s, d):
    return manifests.leaf_rows(*_tax(s, d), _species(s, d))


@query("species_ids", f"WITH {_SPECIES} SELECT qid, trim(xeno_canto_species_id) AS xeno_canto_species_id FROM c WHERE trim(xeno_canto_species_id) <> ''")
def species_ids(s, d):
    return entity.species_ids(_species(s, d).withColumn("id", F.col("qid")).withColumn("qid", F.when(F.startswith("qid", F.lit("C")), F.lit("  ")).otherwise(F.col("qid"))))


@query("modality_union", "SELECT l_partkey::VARCHAR AS qid FROM lineitem UNION SELECT p_partkey::VARCHAR FROM part UNION SELECT c_custkey::VARCHAR FROM customer")
def modality_union(s, d):
    ids = lambda t, c: read(s, d, t).select(F.col(c).cast("string").alias("qid"))
    return manifests.all_ids(ids("lineitem", "l_partkey"), ids("part", "p_partkey"), ids("customer", "c_custkey"))


@query("split_rows", "SELECT o_orderkey, o_custkey AS qid FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def split_rows(s, d):
    return manifests.only_ids(read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("qid")), read(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("qid")))


@query("label_assignments", "SELECT user_id AS qid, arg_max(event_type, event_id) AS label_qid FROM events GROUP BY 1")
def label_assignments(s, d):
    return manifests.label_of(read(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("label_qid"), "event_id"), "event_id")


@query(
    "example_manifest",
    """WITH f AS (SELECT o_custkey, o_orderkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0|' || o_custkey || '|' || o_orderkey), o_orderkey) - 1 AS pos FROM orders WINDOW w AS (PARTITION BY o_custkey))
 SELECT 'Q' || o_custkey AS qid, o_orderkey::VARCHAR AS recording_id, 'a/Q' || o_custkey || '/' || o_orderkey AS audio_path, 'Q' || o_custkey || '/' || o_orderkey AS relative_path, CASE WHEN n > 1 THEN (pos % 5)::VARCHAR ELSE '' END AS fold_index, CASE WHEN n = 1 THEN '1' ELSE '0' END AS train_only_all_folds, '' AS xeno_canto_species_id, '' AS download_url FROM f""",
)
def example_manifest(s, d):
    x = recordings.fold_assignment(read(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    q = F.concat(F.lit("Q"), "o_custkey")
    rel = F.concat(q, F.lit("/"), "o_orderkey")
    none = F.lit(None).cast("string")
    return manifests.example_manifest(x.select(q.alias("qid"), F.col("o_orderkey").cast("string").alias("recording_id"), F.concat(F.lit("a/"), rel).alias("audio_path"), rel.alias("relative_path"), "fold_index", F.col("train_only").alias("train_only_all_folds"), none.alias("xeno_canto_species_id"), none.alias("download_url")))


@query("article_manifest", "SELECT 'N' || n_nationkey AS qid, 'en' AS language, n_name AS title, 'https://en.wikipedia.org/wiki/Special:Export/' || replace(url_encode(n_name), '+', '%20') AS xml_url, 'x/N' || n_nationkey || '.xml' AS xml_output_path, 't/N' || n_nationkey || '.txt' AS text_output_path FROM nation WHERE n_nationkey % 4 <> 0")
def article_manifest(s, d):
    return manifests.article_manifest(read(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("qid"), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.concat(F.col("n_name"), F.lit(" "))).alias("title")), "en", "x/", "t")


@query("rank_rows", f"WITH {TAX} SELECT 'unknown' AS taxon_rank_qid, taxon_rank_name, 'graph' AS name_source, count(*)::VARCHAR AS node_count FROM tax GROUP BY ALL")
def rank_rows(s, d):
    return manifests.rank_rows(graph.rank_counts(_tax(s, d)[0]))


@query("rank_fallback", "SELECT CASE n_nationkey % 4 WHEN 0 THEN 'Q7432' WHEN 1 THEN 'Q35409' WHEN 2 THEN 'Q999' ELSE 'unknown' END AS taxon_rank_qid, CASE n_nationkey % 4 WHEN 0 THEN 'species' WHEN 1 THEN 'family' ELSE 'unknown' END AS taxon_rank_name, CASE WHEN n_nationkey % 4 < 2 THEN 'fallback_wikidata' ELSE 'unknown' END AS name_source, count(*) AS node_count FROM nation GROUP BY ALL")
def rank_fallback(s, d):
    item = F.element_at(F.array(F.lit("Q7432"), F.lit("Q35409"), F.lit("Q999"), F.lit(" ")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return graph.rank_counts(read(s, d, "nation").select(F.lit(" ").alias("taxon_rank_name"), item.alias("taxon_rank")), item_col="taxon_rank")


@query("fetch_summary", "WITH s AS (SELECT c_custkey, c_acctbal < 0 AS bad FROM customer) SELECT count(*) AS target_qid_count, count(*) FILTER (NOT bad) AS saved_qid_count, count(*) FILTER (bad) AS failed_qid_count, (SELECT string_agg(c_custkey, ',' ORDER BY c_custkey) FROM (SELECT c_custkey FROM s WHERE bad ORDER BY 1 LIMIT 50)) AS failed_qids FROM s")
def fetch_summary(s, d):
    x = manifests.fetch_summary(read(s, d, "customer").select(F.col("c_custkey").alias("qid"), F.when(F.col("c_acctbal") < 0, "api-error").otherwise("ok").alias("status")))
    return x.withColumn("failed_qids", F.array_join(F.col("failed_qids").cast("array<string>"), ","))


@query("first_missing", "SELECT c_custkey AS qid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') ORDER BY 1 LIMIT 20")
def first_missing(s, d):
    t = read(s, d, "customer").select(F.col("c_custkey").alias("qid"))
    return manifests.first_missing(entity.extract(read(s, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("qid")), t)[1])


@query("capped_rows", "SELECT qid, o_orderkey FROM (SELECT o_custkey AS qid, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 30)) WHERE n <= 2")
def capped_rows(s, d):
    o = read(s, d, "orders").select(F.col("o_custkey").alias("qid"), "o_orderkey")
    return manifests.capped_rows(manifests.capped_ids(o, 30), 2, ["o_orderkey"])


@query("language_manifests", f"WITH {_NAMES} SELECT qid, language, surface_text, source, source_index, ordinal, qid || '_en_' || ordinal AS surface_id FROM o UNION ALL SELECT 'P' || p_partkey, 'ja', p_brand, 'ja_name', 0, 0, 'P' || p_partkey || '_ja_0' FROM part")
def language_manifests(s, d):
    ja = read(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("qid"), F.col("p_brand").alias("n"), F.lit("").alias("a"), F.lit(None).cast("string").alias("t"))
    return manifests.by_language(surfaces.ordinals(_names(s, d)), surfaces.ordinals(surfaces.candidates(ja, "n", "a", "t", ("ja_name", "ja_aliases", "jawiki_title"), "ja")))


@query("recording_rows", "SELECT l_orderkey::VARCHAR AS qid, l_returnflag AS xeno_canto_species_id, count(*)::INT AS recording_count, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS recording_ids FROM lineitem GROUP BY 1, 2")
def recording_rows(s, d):
    x = read(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("qid"), F.col("l_returnflag").alias("xeno_canto_species_id"), F.col("l_partkey").cast("string").alias("recording_id"), F.lit(None).cast("string").alias("download_url"), F.col("l_linenumber").alias("row_idx"))
    return manifests.recordings_from_rows(x).select("qid", "xeno_canto_species_id", "recording_count", F.array_join("recording_ids", ",").alias("recording_ids"))


@query("existing_files", "SELECT 'Q' || l_orderkey AS qid, l_partkey::VARCHAR AS recording_id, 'Q' || l_orderkey || '/' || l_partkey || '.mp3' AS path, l_suppkey AS size FROM lineitem WHERE l_linenumber % 3 = 0")
def existing_files(s, d):
    name = F.concat(F.col("l_partkey"), F.when(F.col("l_linenumber") % 3 == 0, ".mp3").otherwise(".mp3.tmp"))
    path = F.when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit("file:/data/audio/"), name)).otherwise(F.concat(F.lit("file:/data/audio/Q"), "l_orderkey", F.lit("/"), name))
    return manifests.existing_files(read(s, d, "lineitem").where("l_linenumber % 3 <> 2").select(path.alias("path"), F.col("l_suppkey").alias("length")), "audio")


@query("audio_backfill_left", "SELECT l_orderkey AS qid, l_partkey::VARCHAR AS recording_id, CASE WHEN l_partkey % 2 = 0 THEN 'https://xeno-canto.org/' || l_partkey || '/download' ELSE '' END AS download_url FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def audio_backfill_left(s, d):
    """Files joined with the recording index on both keys; blank where it knows none."""
    x = read(s, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").cast("string").alias("recording_id")).distinct()
    idx = x.where("recording_id % 2 = 0").select("qid", "recording_id", X.recording_url(F.col("recording_id")).alias("download_url"))
    return recordings.backfilled(x, idx)


@query("id_from_path", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN l_linenumber % 2 = 0 THEN 'Q' || l_orderkey ELSE 'misc' END AS qid, CASE WHEN l_linenumber = 1 THEN 'x_' || l_partkey WHEN l_linenumber % 2 = 0 THEN 'Q' || l_orderkey || '_' || l_partkey ELSE 'x_a_misc_' || l_partkey END AS audio_id FROM lineitem")
def id_from_path(s, d):
    n = F.col("l_linenumber")
    rel = F.when(n == 1, F.concat("l_partkey", F.lit(".mp3"))).when(n % 2 == 0, F.concat(F.lit("Q"), "l_orderkey", F.lit("/"), "l_partkey", F.lit(".wav"))).otherwise(F.concat(F.lit("a/misc/"), "l_partkey", F.lit(".flac")))
    x = read(s, d, "lineitem").withColumn("rel", rel)
    return x.select("l_orderkey", "l_linenumber", X.first_id_part("rel").alias("qid"), X.audio_id(F.when(n % 2 == 0, F.concat(F.lit("Q"), "l_orderkey")).otherwise("x"), "rel").alias("audio_id"))


# ---- addresses, kinds, details


@query("api_urls", """SELECT c_custkey, 'https://xeno-canto.org/' || c_custkey AS page, 'sp:"' || lower(c_mktsegment) || '"' || CASE WHEN c_custkey % 2 = 0 THEN ' q:A' ELSE '' END AS query,
 'https://xeno-canto.org/api/3/recordings?query=sp%3A%22' || lower(c_mktsegment) || '%22' || CASE WHEN c_custkey % 2 = 0 THEN '%20q%3AA' ELSE '' END || '&page=' || c_nationkey || '&per_page=500&key=a%20key' AS url FROM customer""")
def api_urls(s, d):
    sp, q = F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, " a ").otherwise("")
    return read(s, d, "customer").select("c_custkey", X.recording_page(F.col("c_custkey").cast("string")).alias("page"), X.api_query(sp, q).alias("query"), X.api_url(sp, q, F.col("c_nationkey"), 500, "a key").alias("url"))


@query("codec_args", "SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN '-c:a libmp3lame -q:a 2' WHEN l_returnflag = 'R' THEN '-c:a pcm_s16le' ELSE '-c:a copy' END AS args FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def codec_args(s, d):
    kind = F.when(F.col("l_returnflag") == "A", " MP3").when(F.col("l_returnflag") == "R", "wav").otherwise(F.col("l_returnflag"))
    return read(s, d, "lineitem").select("l_returnflag").distinct().select("l_returnflag", F.array_join(X.codec_args(kind), " ").alias("args"))


@query("file_types", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'wav' WHEN 1 THEN 'flac' ELSE 'mp3' END AS file_type FROM lineitem")
def file_types(s, d):
    n = F.col("l_linenumber") % 3
    url = F.when(n == 0, "http://x.org/a/b.WAV?x=1.mp3").otherwise("http://x.org/download")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.file_type(url, F.when(n == 1, "q/1.flac").otherwise("q/1")).alias("file_type"))


@query("node_details", f"WITH {TAX} SELECT qid, 'QID: ' || qid || chr(10) || 'English label: ' || label_en || chr(10) || 'Taxon rank: ' || taxon_rank_name || ' ()' || chr(10) || 'Taxon name: ' || CASE WHEN parent_taxon = '' THEN '' ELSE chr(10) || 'Wikidata: https://www.wikidata.org/entity/' || qid END AS details FROM tax")
def node_details(s, d):
    n = _tax(s, d)[0]
    url = F.when(F.col("parent_taxon") != "", F.concat(F.lit("https://www.wikidata.org/entity/"), "qid"))
    return n.select("qid", X.details(F.col("qid"), F.col("label_en"), F.col("taxon_rank_name"), F.lit(None).cast("string"), F.lit(""), url, F.lit("")).alias("details"))


@query("rank_titles", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Q7432' WHEN 1 THEN 'Q999' WHEN 2 THEN 'tribe' ELSE 'other' END AS key, CASE n_nationkey % 4 WHEN 0 THEN 'species' WHEN 1 THEN 'Q999' WHEN 2 THEN 'Tribe' ELSE 'other / missing' END AS title FROM nation")
def rank_titles(s, d):
    k = F.col("n_nationkey") % 4
    rank, name = F.when(k == 0, "Q7432 ").when(k == 1, "Q999"), F.when(k == 2, " Tribe")
    return read(s, d, "nation").select("n_nationkey", X.rank_key(rank, name).alias("key"), X.rank_title(rank, name, graph.RANK_NAMES).alias("title"))


@query("gradient_colors", """WITH n AS (SELECT n_nationkey, n_nationkey * 2 / 24.0::DOUBLE AS z FROM nation), c AS (SELECT n_nationkey, least(floor(z), 1)::INT AS l, z - least(floor(z), 1) AS t FROM n)
 SELECT n_nationkey, '#' || string_agg(lpad(to_hex(round_even(a + (b - a) * t, 0)::BIGINT), 2, '0'), '' ORDER BY i) AS color FROM (SELECT n_nationkey, t, i, x[l + 1][i] AS a, x[l + 2][i] AS b FROM (SELECT *, [[16, 32, 48], [255, 128, 0], [0, 250, 99]] AS x FROM c), generate_series(1, 3) g(i)) GROUP BY 1""")
def gradient_colors(s, d):
    return read(s, d, "nation").select("n_nationkey", X.gradient_over(["#102030", "#FF8000", "#00FA63"], F.col("n_nationkey"), F.lit(25)).alias("color"))


# ---- entities with all their columns


def _tax_entities(s, d):
    """The taxonomy as entities: claims for rank and parent, aliases, pictures, a name in a second language."""
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    claim = lambda p, v: F.concat(F.lit(f'"{p}":[{{"mainsnak":{{"datavalue":{{"value":'), v, F.lit("}}}]"))
    rank = F.element_at(F.create_map(*[F.lit(x) for r, i in (("class", "Q37517"), ("order", "Q36602"), ("family", "Q35409"), ("species", "Q7432"), ("subspecies", "Q68947")) for x in (r, i)]), F.col("taxon_rank_name"))
    ref = lambda c: F.concat(F.lit('{"id":"'), c, F.lit('"}'))
    claims = F.concat_ws(",", claim("P105", ref(rank)), F.when(F.col("parent_taxon") != "", claim("P171", ref(F.col("parent_taxon")))), claim("P225", q(F.lower("en_name"))), F.when(F.col("pos") <= 2, claim("P18", q(F.concat("qid", F.lit(".jpg"))))))
    aliases = F.when(F.col("pos") < 3, F.concat(F.lit('"en":[{"value":"'), "qid", F.lit(' x"},{"value":""},"y"]'))).otherwise("")
    body = F.concat(F.lit('{"id":"'), "qid", F.lit('","type":"item","labels":{"en":{"value":"'), "en_name", F.lit('"},"ja":{"value":"j '), "en_name", F.lit('"}},"aliases":{'), aliases, F.lit('},"claims":{'), claims, F.lit('},"sitelinks":{"enwiki":{"title":"'), "en_name", F.lit(' a"}}}'))
    ranks = s.createDataFrame([(f'{{"id":"{i}","type":"item","labels":{{"en":{{"value":"{n}"}}}}}}', "0") for i, n in graph.RANK_NAMES.items()], "value string, path_order string")
    rows = tax_rows(s, d)
    # the same id twice: the last by path counts
    old = rows.where("pos = 1").select(F.concat(F.lit('{"id":"'), "qid", F.lit('","type":"item","labels":{"en":"old"}}')).alias("value"), F.lit("0").alias("path_order"))
    whole = F.when(F.col("pos") == 2, F.concat(F.lit('{"entities":{"'), "qid", F.lit('":'), body, F.lit("}}"))).otherwise(body)
    return entity.parse(ranks.union(old).union(rows.select(whole, F.lit("1"))))


_ENT = f"""RECURSIVE {TAX}, up AS (SELECT qid, parent_taxon AS ancestor, 1 AS distance FROM tax WHERE parent_taxon <> '' UNION ALL SELECT up.qid, t.parent_taxon, distance + 1 FROM up JOIN tax t ON t.qid = up.ancestor WHERE t.parent_taxon <> '')"""


@query(
    "ontology_rows",
    f"""WITH {_ENT}, r(name, item) AS (VALUES ('class', 'Q37517'), ('order', 'Q36602'), ('family', 'Q35409'), ('species', 'Q7432'), ('subspecies', 'Q68947'))
 SELECT t.qid, 'https://www.wikidata.org/entity/' || t.qid AS entity_url, t.label_en AS en_name, 'j ' || t.label_en AS ja_name, CASE WHEN t.taxon_rank_name IN ('class', 'order', 'family') THEN '["' || t.qid || ' x","y"]' ELSE '[]' END AS en_aliases, '[]' AS ja_aliases,
 CASE WHEN t.taxon_rank_name IN ('class', 'order', 'family') THEN '["' || t.qid || '.jpg"]' ELSE '[]' END AS img_names, '' AS xeno_canto_species_id, lower(t.label_en) AS taxon_name, r.item AS taxon_rank, t.taxon_rank_name, '' AS taxon_rank_ja_name, t.parent_taxon, coalesce(p.label_en, '') AS parent_taxon_name, coalesce('j ' || p.label_en, '') AS parent_taxon_ja_name,
 t.label_en || ' a' AS enwiki_title, 'https://en.wikipedia.org/wiki/' || replace(url_encode(replace(t.label_en || ' a', ' ', '_')), '%23', '%23') AS enwiki_url, '' AS jawiki_title, '' AS jawiki_url,
 '/' || coalesce((SELECT string_agg(ancestor, '/' ORDER BY distance DESC) FROM up WHERE up.qid = t.qid) || '/', '') || t.qid AS path FROM tax t JOIN r ON r.name = t.taxon_rank_name LEFT JOIN tax p ON p.qid = t.parent_taxon""",
)
def ontology_rows(s, d):
    return entity.ontology(_tax_entities(s, d), root="ROOT").where("parent_taxon <> '' or qid = 'ROOT'")


# ---- readers and writers


@query("tsv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || chr(9) || '\"q\"' END AS name FROM customer")
def tsv_round_trip(s, d):
    p = folder(s, "tsv")
    files.write_tsv(read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat("c_name", F.lit('\t"q"'))).alias("name")), p)
    return files.tsv(s, p)


@query("ids_from_tsv", "SELECT 'C' || c_custkey AS qid FROM customer WHERE c_custkey % 5 <> 0")
def ids_from_tsv(s, d):
    p = folder(s, "ids")
    files.write_tsv(read(s, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" C"), "c_custkey")).alias("qid")), p)
    return files.ids(s, p)


@query("dump_lines", "SELECT 'Q' || n_nationkey AS qid, n_name AS en_name FROM nation")
def dump_lines(s, d):
    p = folder(s, "dump")
    line = F.concat(F.lit('{"id":"Q'), "n_nationkey", F.lit('","type":"item","labels":{"en":{"value":"'), "n_name", F.lit('"}}},'))
    x = read(s, d, "nation").select(line.alias("value")).union(s.createDataFrame([("[",), ("]",)], "value string"))
    x.coalesce(1).write.option("compression", "bzip2").text(p)
    return entity.parse(files.dump_lines(s, p)).select(F.col("entity.id").alias("qid"), entity.label(F.col("entity"), "en").alias("en_name"))


@query("entity_files", "SELECT 'Q' || n_nationkey AS qid, n_name AS en_name FROM nation WHERE n_nationkey < 6")
def entity_files(s, d):
    p = folder(s, "entities")
    for r in read(s, d, "nation").where("n_nationkey < 6").collect():  # six files
        sinks.write_text(s, f"{p}/{r.n_nationkey % 2}/Q{r.n_nationkey}.json", '{"id":"Q%d","type":"item",\n"labels":{"en":{"value":"%s"}}}' % (r.n_nationkey, r.n_name))
        sinks.write_text(s, f"{p}/other{r.n_nationkey}.json", "{}")
    return entity.ontology(entity.parse(files.entity_files(s, p))).select("qid", "en_name")


@query("page_files", "SELECT 'Q' || r_regionkey AS qid, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS recording_ids FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def page_files(s, d):
    p = folder(s, "pages")
    x = read(s, d, "nation").select(F.concat(F.lit("Q"), "n_regionkey").alias("qid"), "n_nationkey").orderBy("qid", "n_nationkey").collect()  # 25 rows
    for q in {r.qid for r in x}:
        own = [r.n_nationkey for r in x if r.qid == q]
        for k, part in enumerate((own[:3], own[3:], [])):
            sinks.write_json(s, f"{p}/{q}/page{k + 1:04d}.json", {"recordings": [{"id": str(i), "file": ""} for i in part]})
    return recordings.recording_map(files.page_files(s, p)).select("qid", F.array_join("recording_ids", ",").alias("recording_ids"))


@query("wiki_pages", "SELECT n_name AS title, 'new text of ' || n_name AS wikitext FROM nation")
def wiki_pages(s, d):
    p = folder(s, "wiki")
    x = read(s, d, "nation").select(F.concat(F.lit("<page><title>"), "n_name", F.lit('</title><revision><text xml:space="preserve">old</text></revision><revision><text>new text of '), "n_name", F.lit("</text></revision></page>")).alias("v"))
    x.agg(F.concat(F.lit("<mediawiki>"), F.concat_ws("\n", F.collect_list("v")), F.lit("</mediawiki>"))).write.text(p)  # 25 pages
    return files.wiki_pages(s, p)


def _stored_runs(s, d) -> str:
    """A graph run and an audio run of the nations, as folders."""
    import io

    import numpy as np

    p = folder(s, "runs")
    rows = read(s, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    for path, vec, qids in (("graph/gcn/01", lambda r: [r.n_nationkey, 1.0], [f"N{r.n_nationkey}" for r in rows]), ("audio/perch/v/01", lambda r: [r.n_nationkey, r.n_regionkey], [f"R{r.n_regionkey}" for r in rows])):
        b = io.BytesIO()
        np.save(b, np.array([vec(r) for r in rows], np.float32))
        sinks.write_bytes(s, f"{p}/{path}/embeddings.npy", b.getvalue())
        sinks.write_json(s, f"{p}/{path}/qids.json", qids)
        sinks.write_json(s, f"{p}/{path}/audio_ids.json", [f"a{r.n_nationkey}" for r in rows])
    body = "audio_id\tqid\trelative_path\twindow_index\n" + "".join(f"\t\tf{r.n_nationkey % 2}.mp3\t{'' if r.n_nationkey < 9 else 3}\n" for r in rows)
    sinks.write_text(s, f"{p}/audio/perch/v/01/audio_manifest.tsv", body)
    sinks.write_json(s, f"{p}/runs.json", {"runs": {"graph": {"g": "graph/gcn/01"}, "audio": {"p": f"{p}/audio/perch/v/01"}}})
    return p


@query("run_discovery", "SELECT * FROM (VALUES ('graph', 'gcn__01', 'g'), ('audio', 'perch__v__01', 'p')) t(modality, label, registered)")
def run_discovery(s, d):
    p = _stored_runs(s, d)
    below = lambda path: path.rsplit("/runs-", 1)[1]
    named = {below(r.path): r.label for r in stores.registry(s, f"{p}/runs.json", p)}
    return s.createDataFrame([(r.modality, r.label, named.get(below(r.path))) for r in stores.discover_all(s, p)], "modality string, label string, registered string")


@query("stored_graph_run", "SELECT n_nationkey::INT AS row_idx, 'N' || n_nationkey AS qid, n_nationkey::DOUBLE AS x FROM nation")
def stored_graph_run(s, d):
    return stores.graph_run(s, f"{_stored_runs(s, d)}/graph/gcn/01").select("row_idx", "qid", F.get("embedding", 0).cast("double").alias("x"))


@query("stored_audio_run", "SELECT n_nationkey::INT AS row_idx, 'a' || n_nationkey AS audio_id, 'R' || n_regionkey AS qid, CASE WHEN n_nationkey < 9 THEN 0 ELSE 3 END AS window_index FROM nation")
def stored_audio_run(s, d):
    return stores.audio_rows(s, f"{_stored_runs(s, d)}/audio/perch/v/01").select("row_idx", "audio_id", "qid", "window_index")


@query("stored_bundles", "SELECT 'G' AS modality, 'g' AS label, 'N' || n_nationkey AS qid, 'N' || n_nationkey AS source_id, 0 AS pos, n_nationkey::DOUBLE AS x FROM nation UNION ALL SELECT 'A', 'p', qid, f, (row_number() OVER (PARTITION BY qid ORDER BY f) - 1)::INT, x FROM (SELECT 'R' || n_regionkey AS qid, 'f' || n_nationkey % 2 || '.mp3' AS f, round(avg(n_nationkey), 6) AS x FROM nation GROUP BY 1, 2)")
def stored_bundles(s, d):
    p = _stored_runs(s, d)
    return stores.bundles(s, stores.registry(s, f"{p}/runs.json", p)).select("modality", "label", "qid", "source_id", "pos", F.round(F.get("embedding", 0), 6).alias("x"))


@query("upserted", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer UNION ALL SELECT -1, 'new'")
def upserted(s, d):
    p = folder(s, "upsert")
    c = read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    sinks.replaced(c, p)
    new = c.where("k % 3 = 0").select("k").union(s.range(1).select(F.lit(-1).cast("long")))
    sinks.upsert(new.crossJoin(s.createDataFrame([("first",), ("new",)], "v string")), p, ["k"], F.col("v"))  # two rows
    return s.read.parquet(p)


@query("shards_skip_existing", "SELECT 'Q' || n_nationkey AS qid, CASE WHEN n_nationkey < 10 THEN 'old' ELSE 'new' END AS value FROM nation")
def shards_skip_existing(s, d):
    p = folder(s, "shards")
    n = read(s, d, "nation").select(F.concat(F.lit("Q"), "n_nationkey").alias("qid"), "n_nationkey")
    sinks.shard_entities(n.where("n_nationkey < 10").select("qid", F.lit("old").alias("value")), p)
    return sinks.shard_entities(n.select("qid", F.lit("new").alias("value")), p).select("qid", "value")


@query("graph_store", f"WITH {TAX} SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE parent_qid[1] <> 'N') AS edges_left FROM tax")
def graph_store(s, d):
    """A graph written and read, then without its nations and the edges at them."""
    p = folder(s, "graph")
    nodes, edges = _tax(s, d)
    sinks.write_graph(nodes, edges, s.range(1), p)
    n, e = sinks.read_graph(s, p)
    counts = n.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges")))  # one row each
    counts = counts.collect()
    sinks.delete_cascade(f"{p}/nodes", f"{p}/edges", n.where("taxon_rank_name = 'family'"))
    left = sinks.read_graph(s, p)[1].count() + nodes.where("taxon_rank_name = 'family'").count()
    return s.createDataFrame([(*counts[0], left)], "nodes long, edges long, edges_left long")


@query("stream_dedup", "SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup(s, d):
    """Each key once, by a stream over files that ends when it has read them."""
    p = folder(s, "stream")
    src = ingest.source(s, d, read(s, d, "events").schema, glob="events.parquet")
    q = ingest.append(ingest.once_each(src.select("event_type", "user_id"), ["event_type", "user_id"]), f"{p}/out", f"{p}/state")
    q.awaitTermination()
    return s.read.parquet(f"{p}/out")


@query("stream_extract", "SELECT DISTINCT o_custkey AS qid FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def stream_extract(s, d):
    p = folder(s, "extract")
    src = ingest.source(s, d, read(s, d, "orders").schema, glob="orders.parquet").select(F.col("o_custkey").alias("qid"))
    t = read(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("qid"))
    ingest.append(ingest.extract_stream(src, t), f"{p}/out", f"{p}/state").awaitTermination()
    return s.read.parquet(f"{p}/out")


# ---- draws


@query("layered_neighbors", f"""WITH {TAX}, nb AS (SELECT parent_qid AS qid, child_qid AS v FROM edges UNION SELECT child_qid, parent_qid FROM edges),
 a AS (SELECT qid, v, row_number() OVER (PARTITION BY qid ORDER BY md5('0|' || qid || '|' || v), v) AS n FROM nb), l0 AS (SELECT qid, v FROM a WHERE n <= 3 UNION SELECT qid, qid FROM tax),
 b AS (SELECT qid, v, row_number() OVER (PARTITION BY qid ORDER BY md5('1|' || qid || '|' || v), v) AS n FROM l0 WHERE v <> qid), l1 AS (SELECT qid, v FROM b WHERE n <= 2 UNION SELECT qid, qid FROM tax)
 SELECT qid, 0 AS layer, string_agg(v, ',' ORDER BY v) AS neighbors FROM l0 GROUP BY 1 UNION ALL SELECT qid, 1, string_agg(v, ',' ORDER BY v) FROM l1 GROUP BY 1""")
def layered_neighbors(s, d):
    nodes, edges = _tax(s, d)
    near = nodes.select("qid").join(graph.neighbor_map(edges), "qid", "left").select("qid", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"))
    return manifests.layered(near, [3, 2]).select("qid", "layer", F.array_join("neighbors", ",").alias("neighbors"))


@query("sampled_neighbors", f"""WITH {TAX}, nb AS (SELECT parent_qid AS qid, child_qid AS v FROM edges UNION SELECT child_qid, parent_qid FROM edges), a AS (SELECT qid, v, row_number() OVER (PARTITION BY qid ORDER BY md5('0|' || qid || '|' || v), v) AS n FROM nb)
 SELECT qid, string_agg(v, ',' ORDER BY n) AS neighbors FROM a WHERE n <= 5 GROUP BY 1""")
def sampled_neighbors(s, d):
    return embedding.sampled_neighbors(graph.neighbor_map(_tax(s, d)[1]), 5).select("qid", F.array_join("neighbors", ",").alias("neighbors"))


@query("padded_neighbors", f"""WITH {TAX}, a AS (SELECT parent_qid AS qid, child_qid AS v, row_number() OVER (PARTITION BY parent_qid ORDER BY md5('0|' || parent_qid || '|' || child_qid), child_qid) AS n FROM edges)
 SELECT qid, least(count(*), 4)::INT AS used, string_agg(CASE WHEN n <= 4 THEN v END, ',' ORDER BY n) AS neighbors FROM a GROUP BY 1""")
def padded_neighbors(s, d):
    x = manifests.padded(embedding.sampled_neighbors(graph.neighbor_map(_tax(s, d)[1], directed=True), 4), 4)
    return x.where("size(neighbors) = 4 and size(mask) = 4").select("qid", F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("used"), F.array_join("neighbors", ",").alias("neighbors"))


@query("negative_nodes", f"""WITH {TAX}, dg AS (SELECT t.qid, greatest((SELECT count(*) FROM edges e WHERE e.parent_qid = t.qid OR e.child_qid = t.qid), 1) AS dgr FROM tax t),
 w AS (SELECT qid, floor(pow(dgr, 0.75) * 1000000)::BIGINT AS w FROM dg), i AS (SELECT qid, (sum(w) OVER (ORDER BY qid[1:3], qid))::BIGINT AS hi, w FROM w), p AS (SELECT parent_qid AS c, child_qid AS o, k, a FROM edges, generate_series(0, 1) x(k), generate_series(0, 7) y(a) WHERE parent_qid[1] IN ('R', 'ROOT')),
 q AS (SELECT *, (('0x' || substr(md5('0|' || c || '|' || o || '|' || k || '|' || a), 1, 15))::BIGINT) % (SELECT sum(w) FROM w)::BIGINT AS z FROM p), h AS (SELECT c, o, k, a, qid FROM q JOIN i ON z >= hi - i.w AND z < hi WHERE qid <> c AND qid <> o)
 SELECT c AS center, o AS context, k::INT AS place, arg_min(qid, a) AS qid FROM h GROUP BY 1, 2, 3""")
def negative_nodes(s, d):
    nodes, edges = _tax(s, d)
    w = graph.degrees(nodes, edges).select("qid", F.pow(F.greatest("degree", F.lit(1)).cast("double"), 0.75).alias("w"))
    pairs = edges.where("substring(parent_qid, 1, 1) = 'R'").select(F.col("parent_qid").alias("center"), F.col("child_qid").alias("context"))
    return manifests.negative_nodes(pairs, manifests.noise_intervals(w), 2)


_DRAW = "(('0x' || substr(md5({}), 1, 15))::BIGINT) % 100"


@query("edge_dropout", f"WITH {TAX}, x AS (SELECT parent_qid, child_qid, {_DRAW.format(chr(39) + '0|' + chr(39) + ' || parent_qid || ' + chr(39) + '|' + chr(39) + ' || child_qid')} AS z FROM edges) SELECT parent_qid, child_qid, 20 AS percent FROM x WHERE z >= 20 UNION ALL (SELECT parent_qid, child_qid, 100 FROM x ORDER BY z DESC, parent_qid DESC, child_qid DESC LIMIT 1)")
def edge_dropout(s, d):
    e = _tax(s, d)[1].select("parent_qid", "child_qid")
    return manifests.kept_edges(e, 20).withColumn("percent", F.lit(20)).union(manifests.kept_edges(e, 100).withColumn("percent", F.lit(100)))


@query("feature_dropout", f"WITH {VEC}, x AS (SELECT idx, unnest(generate_series(1, 64)) AS i, e FROM v) SELECT idx, round(sum(CASE WHEN {_DRAW.format(chr(39) + '0|' + chr(39) + ' || (i - 1)')} < 30 THEN 0 ELSE e[i] END), 6) AS columns_left, round(sum(CASE WHEN {_DRAW.format(chr(39) + '0|L' + chr(39) + ' || idx || ' + chr(39) + '|' + chr(39) + ' || (i - 1)')} < 30 THEN 0 ELSE e[i] END), 6) AS cells_left FROM x GROUP BY 1")
def feature_dropout(s, d):
    v = vectors(s, d).withColumn("qid", F.concat(F.lit("L"), "idx"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    both = manifests.dropped_features(v.withColumn("cells", F.col("embedding")), "embedding", 30)
    return manifests.dropped_features(both, "cells", 30, cells=True).select("idx", total("embedding").alias("columns_left"), total("cells").alias("cells_left"))


@query("edge_indexes", f"WITH {TAX}, a AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS z FROM tax) SELECT p.z AS head, c.z AS tail FROM edges JOIN a p ON p.qid = parent_qid JOIN a c ON c.qid = child_qid")
def edge_indexes(s, d):
    return manifests.edge_indexes(*_tax(s, d))


# ---- vectors, signals, encoders


@query("vector_diagnostics", f"WITH {VEC}, n AS (SELECT sqrt(list_inner_product(e, e)) AS n FROM v), x AS (SELECT i, var_pop(e[i]) AS s FROM v, generate_series(1, 64) g(i) GROUP BY 1) SELECT round((SELECT avg(n) FROM n), 6) AS embedding_norm_mean, round((SELECT stddev_pop(n) FROM n), 6) AS embedding_norm_std, round(avg(s), 6) AS embedding_variance_mean FROM x")
def vector_diagnostics(s, d):
    x = embedders.vector_diagnostics(vectors(s, d))
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


@query("vectors_in_graph", f"WITH {VEC} SELECT idx FROM v WHERE qid IN ('L1', 'L3')")
def vectors_in_graph(s, d):
    """Vectors whose id is a node."""
    return manifests.only_ids(vectors(s, d), s.createDataFrame([("L1",), ("L3",), ("X",)], "qid string")).select("idx")


@query("gathered_vectors", f"WITH {VEC}, l AS (SELECT qid, max(idx) AS idx FROM v GROUP BY 1), w AS (SELECT qid, min(idx) AS pos FROM v GROUP BY 1) SELECT pos, qid, round(v.e[1], 6) AS x FROM w JOIN l USING (qid) JOIN v USING (qid, idx)")
def gathered_vectors(s, d):
    v = vectors(s, d)
    wanted = v.groupBy("qid").agg(F.min("idx").alias("pos"))
    return runs.gathered(v.withColumnRenamed("idx", "row_idx"), wanted).select("pos", "qid", F.round(F.get("embedding", 0), 6).alias("x"))


@query("aligned_members", "WITH m AS (SELECT DISTINCT l_returnflag AS run, 'P' || l_partkey AS qid FROM lineitem), c AS (SELECT qid FROM m GROUP BY 1 HAVING count(*) = 3) SELECT run, qid FROM m JOIN c USING (qid)")
def aligned_members(s, d):
    return runs.aligned(read(s, d, "lineitem").select(F.col("l_returnflag").alias("run"), F.concat(F.lit("P"), "l_partkey").alias("qid")).distinct(), 3).select("run", "qid")


@query("one_dimension", "SELECT count(*) AS row_count, min(len(embedding)) = max(len(embedding)) AS one_dimension FROM embeddings")
def one_dimension(s, d):
    return runs.check_aligned(read(s, d, "embeddings"))


@query("language_rows", "SELECT n_nationkey AS row_idx, 'N' || n_nationkey AS surface_id, CASE WHEN n_nationkey % 2 = 0 THEN 'ja' ELSE 'en' END AS language, CASE WHEN n_nationkey % 2 = 0 THEN 'last' END AS surface_text FROM nation")
def language_rows(s, d):
    n = read(s, d, "nation")
    ids = n.select(F.col("n_nationkey").alias("row_idx"), F.concat(F.lit("N"), "n_nationkey").alias("surface_id"))
    m = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("surface_id"), F.lit("ja").alias("language"))
    both = m.withColumn("surface_text", F.lit("first")).withColumn("row_no", F.lit(0)).union(m.withColumn("surface_text", F.lit("last")).withColumn("row_no", F.lit(1)))
    return runs.language_run(ids, both)


@query("compatible_runs", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 1")
def compatible_runs(s, d):
    n = read(s, d, "nation").withColumn("window", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")))
    return n.where(runs.compatible({"n_regionkey": 2, "window": None})).select("n_nationkey")


@query("run_specs", "SELECT * FROM (VALUES ('G', 'a'), ('G', 'b'), ('GL', 'a,x'), ('GL', 'a,y'), ('GL', 'b,x'), ('GL', 'b,y')) t(modalities, runs)")
def run_specs(s, d):
    return s.createDataFrame([(m, ",".join(r)) for m, r in runs.specs({"G": ["b", "a"], "L": ["x", "y"], "A": []}, ["g", "LG", "GA"])], "modalities string, runs string")


@query("retrieval_other_file", f"WITH {_SIM}, r AS (SELECT q, (qq = cq AND q // 10 <> c // 10)::INT AS rel, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rk FROM p WHERE q <> c), h AS (SELECT *, sum(rel) OVER (PARTITION BY q ORDER BY rk) AS hits FROM r) SELECT q, count(*) AS relevant_count, round(avg(hits / rk), 6) AS average_precision, round(1.0::DOUBLE / min(rk), 6) AS reciprocal_rank FROM h WHERE rel = 1 GROUP BY 1")
def retrieval_other_file(s, d):
    """Relevant is what has the id and comes from another file."""
    v = vectors(s, d).withColumn("relative_path", F.floor(F.col("idx") / 10).cast("string"))
    x = similarity.metrics(v, v, not_same="relative_path")
    return x.select("q", "relevant_count", F.round("average_precision", 6).alias("average_precision"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query("activations", f"WITH {VEC}, x AS (SELECT idx, unnest(e) AS x FROM v) SELECT idx, round(sum(1 / (1 + exp(-x))), 6) AS sigmoids, round(sum(ln(1 + exp(x))), 6) AS softplus FROM x GROUP BY 1")
def activations(s, d):
    total = lambda f: F.round(F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda a, x: a + x), 6)
    return vectors(s, d).select("idx", total(V.sigmoid).alias("sigmoids"), total(V.softplus).alias("softplus"))


@query("softmax_shares", f"WITH {VEC}, x AS (SELECT idx, e, list_max(e) AS m FROM v), y AS (SELECT idx, e, m, list_sum(list_transform(e, lambda z: exp(z - m))) AS t FROM x) SELECT idx, (list_position(e, m) - 1)::INT AS best, round(1 / t, 6) AS share, round(-ln(greatest(exp(e[1] - m) / t, 1e-8)), 6) AS loss FROM y")
def softmax_shares(s, d):
    p = V.softmax(F.col("embedding"))
    return vectors(s, d).select("idx", V.argmax(p).alias("best"), F.round(F.array_max(p), 6).alias("share"), F.round(-F.log(F.greatest(F.get(p, 0), F.lit(1e-8))), 6).alias("loss"))


@query("masked_means", f"WITH {VEC}, x AS (SELECT qid, idx, e[1] AS x, idx % 3 <> 0 AS m FROM v) SELECT qid, round(coalesce(sum(x) FILTER (m), 0) / greatest(count(*) FILTER (m), 1), 6) AS x FROM x GROUP BY 1")
def masked_means(s, d):
    g = vectors(s, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("idx", "embedding"))).alias("t"))
    out = manifests.masked_mean(F.transform("t", lambda r: r["embedding"]), F.transform("t", lambda r: (r["idx"] % 3 != 0).cast("double")))
    return g.select("qid", F.round(F.get(out, 0), 6).alias("x"))


@query("mono_mix", f"WITH {VEC} SELECT a.idx, round((a.e[1] + b.e[1]) / 2, 6) AS first, round((a.e[64] + b.e[64]) / 2, 6) AS last FROM v a JOIN v b ON b.idx = a.idx + 1")
def mono_mix(s, d):
    v = vectors(s, d)
    x = v.join(v.select((F.col("idx") - 1).alias("idx"), F.col("embedding").alias("b")), "idx").withColumn("m", manifests.mono(F.array("embedding", "b")))
    return x.select("idx", F.round(F.get("m", 0), 6).alias("first"), F.round(F.get("m", 63), 6).alias("last"))


@query("resampled_ramp", "WITH x AS (SELECT n_nationkey, n_nationkey + 2 AS n, round_even((n_nationkey + 2) * 5 / 4.0, 0)::INT AS m FROM nation) SELECT n_nationkey, m AS size, round(sum(least(j * n / m::DOUBLE, n - 1)), 4) AS total FROM x, generate_series(0, 40) g(j) WHERE j < m GROUP BY 1, 2")
def resampled_ramp(s, d):
    w = F.transform(F.sequence(F.lit(0), (F.col("n_nationkey") + 1).cast("int")), lambda i: i.cast("float"))
    x = signals.resampled(read(s, d, "nation").select("n_nationkey", w.alias("wave"), F.lit(4).alias("rate")), "wave", "rate", 5)
    return x.select("n_nationkey", F.size("samples").alias("size"), F.round(F.aggregate(F.col("samples").cast("array<double>"), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("encode_retry", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id + 1)::DOUBLE END AS x, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: seven' END AS error FROM documents")
def encode_retry(s, d):
    """A batch that fails is tried row by row."""
    ready(s)

    def encode(rows):
        if any(i % 7 == 0 for (i,) in rows):
            raise ValueError("seven")
        return [[i + 1.0] for (i,) in rows]

    x = signals.encoded(read(s, d, "documents").select("doc_id"), encode, ["doc_id"])
    return x.select("doc_id", F.get("embedding", 0).cast("double").alias("x"), "error")


@query("encode_files", "SELECT n_nationkey, k::INT AS window_index, k / 2.0::DOUBLE AS start_seconds, NULL AS error FROM nation, generate_series(0, 3) g(k) WHERE k < n_nationkey % 4 AND n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, NULL, NULL, 'OSError: unreadable' FROM nation WHERE n_nationkey % 5 = 0")
def encode_files(s, d):
    """None, one or more rows a file, or its error."""

    def encode(path):
        n = int(path)
        if n % 5 == 0:
            raise OSError("unreadable")
        return [{"embedding": [n, k], "start": k / 2.0} for k in range(n % 4)]

    x = signals.encoded_files(read(s, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("path")), encode, "path")
    return x.select("n_nationkey", "window_index", "start_seconds", "error")


@query("build_resumed", "SELECT n_nationkey::VARCHAR AS audio_id, CASE WHEN n_nationkey % 2 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS x FROM nation")
def build_resumed(s, d):
    """A store built in two goes: the second takes what the first left out or failed at."""
    p = folder(s, "build")
    n = read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("audio_id"))

    def encode(value, bad):
        return lambda t: t.withColumn("embedding", F.when(~bad, F.array(F.lit(value)))).withColumn("error", F.when(bad, "failed"))

    signals.built(n.where("audio_id < 20"), p, encode(1.0, F.col("audio_id") % 2 == 1), batches=3)
    signals.built(n.where("audio_id % 2 = 0"), p, encode(1.0, F.lit(False)), batches=2)
    return signals.built(n, p, encode(2.0, F.lit(False)), batches=2).select("audio_id", F.get("embedding", 0).alias("x"))


@query("backends", "SELECT * FROM (VALUES ('birdnet', 'window', 48000, 3.0::DOUBLE), ('perch', 'window', 32000, 5.0::DOUBLE), ('wav2vec2', 'file', 16000, NULL)) t(name, scope, sample_rate_hz, window_seconds)")
def backends(s, d):
    return s.createDataFrame([(b.name, b.scope, b.sample_rate_hz, b.window_seconds) for b in map(signals.backend, signals.BACKENDS)], "name string, scope string, sample_rate_hz int, window_seconds double")


@query("cluster_assignments", f"WITH {_CL} SELECT v.idx::VARCHAR AS qid, v.qid AS true_label, (list_position(e, list_max(e)) - 1)::VARCHAR AS cluster_id FROM v")
def cluster_assignments(s, d):
    """Assignments as they are written to a report and read back."""
    p = folder(s, "clusters")
    x = vectors(s, d).select(F.col("idx").cast("string").alias("qid"), F.col("qid").alias("true_label"), V.argmax(F.col("embedding")).alias("cluster_id"))
    row = {"method": "argmax", **dict.fromkeys(sinks.METRICS, 0.5), "mean_rank": 1.0}
    sinks.write_cluster_report(s.createDataFrame([row]), {"argmax": x}, p, "label", "g", "e")
    return files.tsv(s, f"{p}/argmax_assignments")


@query("evaluation_files", "SELECT split, row_count::VARCHAR AS row_count, printf('%.6f', accuracy) AS accuracy, printf('%.6f', accuracy / 2) AS macro_f1 FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS row_count, avg(quality) AS accuracy FROM labels GROUP BY 1)")
def evaluation_files(s, d):
    p = folder(s, "evaluation")
    l = read(s, d, "labels").withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test"))  # noqa: E741
    m = l.groupBy("split").agg(F.count("*").alias("row_count"), F.avg("quality").alias("accuracy")).withColumn("macro_f1", F.col("accuracy") / 2)
    text = F.lit("x")
    sinks.write_evaluation(l.select(F.col("doc_id").cast("string").alias("sample_id"), text.alias("qid"), "split", *[text.alias(c) for c in sinks.PREDICTIONS[3:]]), m, p)
    return files.tsv(s, f"{p}/metrics")


# ---- trained models: rows only


def _embedder(kind: str, **more):
    @query(f"{kind}_train")
    def train(s: SparkSession, d: str) -> DataFrame:
        nodes, edges = _tax(s, d)
        return embedders.embedded(kind, nodes, edges, **more)[1]

    return train


_embedder("gcn", size=16, epochs=20, rate=0.01)
_embedder("graphsage", size=16, epochs=10, rate=0.01)
_embedder("grace", size=16, projected=16, epochs=10, rate=0.01)
_embedder("node2vec", size=16, length=6, per_node=1, window=2, epochs=2)

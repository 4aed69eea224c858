"""The library's operators as queries over the driver's tables, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import classify, clustering, embedding, entity, graph, recordings, resume, runs, signals, similarity, surfaces
from .tables import pages_of_recordings, part_names, read, tax_rows, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TAX = """tax AS (SELECT 'ROOT' AS qid, '' AS parent_taxon, 'Root' AS label_en, 'class' AS taxon_rank_name
  UNION ALL SELECT 'R' || r_regionkey, 'ROOT', r_name, 'order' FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 'family' FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name, 'species' FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name, 'subspecies' FROM supplier),
edges AS (SELECT DISTINCT parent_taxon AS parent_qid, qid AS child_qid FROM tax WHERE parent_taxon <> '')"""
UP = f"""RECURSIVE {TAX}, up AS (SELECT qid, parent_taxon AS ancestor, 1 AS distance FROM tax WHERE parent_taxon <> ''
  UNION ALL SELECT up.qid, t.parent_taxon, distance + 1 FROM up JOIN tax t ON t.qid = up.ancestor WHERE t.parent_taxon <> '')"""
DOWN = f"""RECURSIVE {TAX}, tree AS (SELECT qid, 0 AS depth FROM tax WHERE qid = 'ROOT'
  UNION ALL SELECT e.child_qid, depth + 1 FROM tree JOIN edges e ON e.parent_qid = tree.qid)"""
VEC = "v AS (SELECT vec_id AS idx, 'L' || label AS qid, embedding::DOUBLE[] AS e FROM embeddings)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _tax(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.build_graph(tax_rows(s, d))


# ---- taxonomy


@query("tax_nodes", f"WITH {TAX} SELECT * FROM tax")
def tax_nodes(s, d):
    return _tax(s, d)[0]


@query("tax_edges", f"WITH {TAX} SELECT parent_qid, child_qid, 'parent taxon' AS relation FROM edges")
def tax_edges(s, d):
    return _tax(s, d)[1]


@query("tax_placeholders", f"WITH {TAX} SELECT DISTINCT parent_taxon AS qid, parent_taxon AS label_en, '' AS taxon_rank_name, '' AS parent_taxon FROM tax WHERE qid[1] IN ('C', 'S')")
def tax_placeholders(s, d):
    """Nodes that a graph of the leaves alone would add."""
    nodes = graph.build_nodes(tax_rows(s, d).where("pos >= 3"))
    return graph.placeholders(nodes, graph.build_edges(nodes))


@query("tax_orphans", f"WITH {TAX} SELECT parent_qid, child_qid, 'parent taxon' AS relation FROM edges WHERE parent_qid[1] = 'N'")
def tax_orphans(s, d):
    """Foreign keys that the leaves' own table would refuse."""
    nodes = graph.build_nodes(tax_rows(s, d).where("pos >= 3"))
    return graph.orphan_edges(nodes, graph.build_edges(nodes))


@query("tax_children", f"WITH {TAX} SELECT t.* FROM edges e JOIN tax t ON t.qid = e.child_qid WHERE e.parent_qid = 'N3'")
def tax_children(s, d):
    return graph.children(*_tax(s, d), "N3")


@query("tax_descendants_all", f"WITH {DOWN} SELECT t.qid, t.label_en, t.taxon_rank_name, depth FROM tree JOIN tax t USING (qid)")
def tax_descendants_all(s, d):
    nodes, edges = _tax(s, d)
    return graph.descendants(nodes, edges, "ROOT").join(nodes, "qid").select("qid", "label_en", "taxon_rank_name", "depth").orderBy("depth", "qid")


@query("tax_descendants_d2", f"WITH {DOWN} SELECT qid, depth FROM tree WHERE depth <= 2")
def tax_descendants_d2(s, d):
    return graph.descendants(*_tax(s, d), "ROOT", max_depth=2)


@query("tax_ancestors", f"WITH {UP} SELECT * FROM up")
def tax_ancestors(s, d):
    return graph.closure(_tax(s, d)[0])


@query("tax_path", f"WITH {UP} SELECT t.qid, '/' || coalesce((SELECT string_agg(ancestor, '/' ORDER BY distance DESC) FROM up WHERE up.qid = t.qid) || '/', '') || t.qid AS path FROM tax t")
def tax_path(s, d):
    nodes = _tax(s, d)[0]
    return graph.paths(nodes, graph.closure(nodes), "ROOT")


def _label(rank: str) -> str:
    return f"WITH {UP} SELECT up.qid, '{rank}' AS target_rank, ancestor AS label_qid, label_en AS label_name, distance AS distance_to_label FROM up JOIN tax a ON a.qid = ancestor WHERE a.taxon_rank_name = '{rank}'"


for _rank in ("order", "family"):

    @query(f"tax_label_{_rank}", _label(_rank))
    def tax_label(s, d, rank=_rank):
        nodes = _tax(s, d)[0]
        return graph.nearest_of_rank(nodes, graph.closure(nodes), rank)


@query("tax_leaf_count", f"WITH {TAX} SELECT count(*) AS leaves, count(*) FILTER (taxon_rank_name = 'species') AS species FROM tax WHERE qid NOT IN (SELECT parent_qid FROM edges)")
def tax_leaf_count(s, d):
    return graph.leaves(*_tax(s, d)).agg(F.count("*").alias("leaves"), F.count_if(F.col("taxon_rank_name") == "species").alias("species"))


@query("tax_rank_distribution", f"WITH {TAX} SELECT 'unknown' AS taxon_rank_qid, taxon_rank_name, 'graph' AS name_source, count(*) AS node_count FROM tax GROUP BY ALL")
def tax_rank_distribution(s, d):
    return graph.rank_counts(_tax(s, d)[0])


_DETAIL = f"""{UP}, leaf AS (SELECT qid FROM tax WHERE qid NOT IN (SELECT parent_qid FROM edges)),
n AS (SELECT ancestor AS qid, count(DISTINCT up.qid) AS n, count(DISTINCT leaf.qid) AS l FROM up LEFT JOIN leaf USING (qid) GROUP BY 1),
detail AS (SELECT t.*, coalesce(n, 0) AS assigned_node_count, coalesce(l, 0) AS assigned_leaf_node_count FROM tax t LEFT JOIN n USING (qid))"""


@query("tax_subtree_detail", f"WITH {_DETAIL} SELECT * FROM detail")
def tax_subtree_detail(s, d):
    nodes, edges = _tax(s, d)
    return graph.in_rank_order(graph.subtree_sizes(nodes, edges, graph.closure(nodes)), "taxon_rank_name", "assigned_node_count", "qid")


@query(
    "tax_subtree_summary",
    f"""WITH {_DETAIL} SELECT taxon_rank_name, count(*) AS label_count, printf('%.2f', avg(assigned_node_count)) AS mean_nodes, printf('%.2f', median(assigned_node_count)::DOUBLE) AS median_nodes,
 max(assigned_node_count) AS max_nodes, min(assigned_node_count) AS min_nodes, printf('%.2f', avg(assigned_leaf_node_count)) AS mean_leaves, printf('%.2f', median(assigned_leaf_node_count)::DOUBLE) AS median_leaves,
 max(assigned_leaf_node_count) AS max_leaves, count(*) FILTER (assigned_node_count = 0) AS zero_label_count FROM detail GROUP BY 1""",
)
def tax_subtree_summary(s, d):
    nodes, edges = _tax(s, d)
    return graph.subtree_summary(graph.subtree_sizes(nodes, edges, graph.closure(nodes)), "taxon_rank_name")


_DEG = f"""{TAX}, deg AS (SELECT t.qid, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(i, 0) + coalesce(o, 0) AS g FROM tax t
 LEFT JOIN (SELECT child_qid AS qid, count(*) AS i FROM edges GROUP BY 1) USING (qid) LEFT JOIN (SELECT parent_qid AS qid, count(*) AS o FROM edges GROUP BY 1) USING (qid))"""


@query("tax_degree_features", f"WITH {_DEG}, m AS (SELECT max(g) mg, max(i) mi, max(o) mo FROM deg) SELECT qid, round(g / mg, 9) AS f_degree, round(i / mi, 9) AS f_in, round(o / mo, 9) AS f_out, round(ln(1 + g) / ln(1 + mg), 9) AS f_log FROM deg, m")
def tax_degree_features(s, d):
    x = graph.degree_features(*_tax(s, d))
    return x.select("qid", *[F.round(c, 9).alias(c) for c in ("f_degree", "f_in", "f_out", "f_log")])


@query("tax_noise_weights", f"WITH {_DEG} SELECT qid, round(pow(greatest(g, 1), 0.75) / (SELECT sum(pow(greatest(g, 1), 0.75)) FROM deg), 9) AS weight FROM deg")
def tax_noise_weights(s, d):
    return graph.noise_weights(*_tax(s, d)).select("qid", F.round("weight", 9).alias("weight"))


_BFS = f"{DOWN}, b AS (SELECT tree.qid, depth, parent_taxon FROM tree JOIN tax USING (qid) WHERE depth <= 2 ORDER BY depth, parent_taxon, tree.qid LIMIT 20)"


@query("tax_bfs_limited", f"WITH {_BFS} SELECT qid, depth FROM b")
def tax_bfs_limited(s, d):
    return graph.bounded_bfs(*_tax(s, d), "ROOT", 2, 20).select("qid", "depth")


@query("tax_subgraph_edges", f"WITH {_BFS} SELECT parent_qid, child_qid, 'parent taxon' AS relation FROM edges WHERE parent_qid IN (SELECT qid FROM b) AND child_qid IN (SELECT qid FROM b)")
def tax_subgraph_edges(s, d):
    nodes, edges = _tax(s, d)
    return graph.subgraph(edges, graph.bounded_bfs(nodes, edges, "ROOT", 2, 20))


_BOTH = f"{TAX}, nb AS (SELECT parent_qid AS src, child_qid AS dst FROM edges UNION SELECT child_qid, parent_qid FROM edges)"


@query("tax_neighbors", f"WITH {_BOTH} SELECT src AS qid, string_agg(dst, ',' ORDER BY dst) AS neighbors FROM nb GROUP BY 1")
def tax_neighbors(s, d):
    return graph.neighbor_map(_tax(s, d)[1]).select("qid", F.array_join("neighbors", ",").alias("neighbors"))


_ADJ = f"{_BOTH}, a AS (SELECT * FROM nb UNION ALL SELECT qid, qid FROM tax), g AS (SELECT src, count(*) AS d FROM a GROUP BY 1)"


@query("tax_adj_norm", f"WITH {_ADJ} SELECT src, dst, round(1.0::DOUBLE / d, 9) AS weight FROM a JOIN g USING (src)")
def tax_adj_norm(s, d):
    return graph.adjacency(*_tax(s, d)).withColumn("weight", F.round("weight", 9))


@query("tax_adj_sym", f"WITH {_ADJ} SELECT a.src, dst, round(1 / sqrt(g.d::DOUBLE * h.d), 9) AS weight FROM a JOIN g USING (src) JOIN g h ON h.src = a.dst")
def tax_adj_sym(s, d):
    return graph.adjacency(*_tax(s, d), symmetric=True).select("src", "dst", F.round("weight", 9).alias("weight"))


@query(
    "tax_propagate",
    f"""WITH {_ADJ}, dg AS (SELECT t.qid, coalesce(n, 0) / (SELECT max(n) FROM (SELECT count(*) n FROM nb GROUP BY src)) AS f FROM tax t LEFT JOIN (SELECT src AS qid, count(*) n FROM nb GROUP BY 1) USING (qid))
 SELECT a.src AS qid, round(sum(f / g.d), 9) AS f_degree FROM a JOIN g USING (src) JOIN dg ON dg.qid = a.dst GROUP BY 1""",
)
def tax_propagate(s, d):
    nodes, edges = _tax(s, d)
    x = graph.propagate(graph.adjacency(nodes, edges), graph.degree_features(nodes, edges), ["f_degree"])
    return x.select("qid", F.round("f_degree", 9).alias("f_degree"))


@query("tax_elements", f"""WITH {TAX} SELECT 'n:' || qid AS element_id, '{{"id":"' || qid || '","label":"' || label_en || '"}}' AS data FROM tax UNION ALL SELECT 'e:' || parent_qid || '->' || child_qid, '{{"source":"' || parent_qid || '","target":"' || child_qid || '"}}' FROM edges""")
def tax_elements(s, d):
    return graph.elements(*_tax(s, d))


@query("tax_metadata", f"WITH {TAX} SELECT 'node_count' AS key, count(*)::VARCHAR AS value FROM tax UNION ALL SELECT 'edge_count', count(*)::VARCHAR FROM edges UNION ALL SELECT 'root_qid', 'ROOT'")
def tax_metadata(s, d):
    nodes, edges = _tax(s, d)
    count = lambda df, k: df.agg(F.lit(k).alias("key"), F.count("*").cast("string").alias("value"))
    return count(nodes, "node_count").union(count(edges, "edge_count")).union(s.range(1).select(F.lit("root_qid"), F.lit("ROOT"))).orderBy("key")


@query("tax_greys", "SELECT n_name AS name, '#' || repeat(lpad(lower(to_hex(80 + ('0x' || sha1(lower(n_name))[1:8])::BIGINT % 70)), 2, '0'), 3) AS color FROM nation")
def tax_greys(s, d):
    return read(s, d, "nation").select(F.col("n_name").alias("name"), X.grey(F.col("n_name")).alias("color"))


# ---- ids, entities, names


@query("qid_extract_dedup", "SELECT qid, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS qid FROM pages) GROUP BY 1")
def qid_extract_dedup(s, d):
    x = read(s, d, "pages").select("page_id", X.last_segment("url").alias("qid"))
    return recordings.first_seen(x, ["qid"], ["page_id"])


@query("targets_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def targets_semi(s, d):
    t = read(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return entity.extract(read(s, d, "orders").select("o_orderkey", "o_custkey"), t, key="o_custkey")[0]


@query("targets_missing", "SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def targets_missing(s, d):
    t = read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return entity.extract(read(s, d, "orders").where("o_orderpriority = '5-LOW'").select("o_custkey"), t, key="o_custkey")[1]


def _entities(s, d):
    """Events as entities in the dump's form."""
    made = F.concat(F.lit('{"id":"Q'), "event_id", F.lit('","type":"item","labels":{"en":{"language":"en","value":"'), "event_type", F.lit('"}},"claims":{"P1":[{"mainsnak":{"datavalue":{"value":"'), F.get_json_object("props", "$.k"), F.lit('"}}}],"P2":[{"mainsnak":{"datavalue":{"value":{"id":"Q'), "user_id", F.lit('"}}}}]},"sitelinks":{"enwiki":{"title":"'), "event_type", F.lit(' (page)"}}},'))
    return entity.parse(read(s, d, "events").select(made.alias("value")))


@query("claims_json_first", "SELECT 'Q' || event_id AS qid, event_type AS en_name, json_extract_string(props, '$.k') AS p1, 'Q' || user_id AS p2, event_type || ' (page)' AS title FROM events")
def claims_json_first(s, d):
    e = F.col("entity")
    return _entities(s, d).select(e["id"].alias("qid"), entity.label(e, "en").alias("en_name"), entity.claim_string(e, "P1").alias("p1"), entity.claim_entity(e, "P2").alias("p2"), entity.sitelink(e, "enwiki").alias("title"))


@query("entity_rows", "SELECT 'Q' || event_id AS qid, event_type AS en_name, '[]' AS en_aliases, 'https://en.wikipedia.org/wiki/' || event_type || '_(page)' AS enwiki_url FROM events")
def entity_rows(s, d):
    return entity.ontology(_entities(s, d)).select("qid", "en_name", "en_aliases", "enwiki_url")


@query("entity_shards", "SELECT 'Q' || event_id AS qid, ('' || event_id)[1:1] AS d1, CASE WHEN event_id >= 10 THEN ('' || event_id)[2:2] ELSE '0' END AS d2 FROM events")
def entity_shards(s, d):
    return entity.sharded(read(s, d, "events").select(F.concat(F.lit("Q"), "event_id").alias("qid")))


@query("url_build", "SELECT p_partkey, 'https://en.wikipedia.org/wiki/' || replace(replace(url_encode(replace(p_name || ' (' || p_brand || ')', ' ', '_')), '%28', '('), '%29', ')') AS url, 'https://en.wikipedia.org/wiki/Special:Export/' || replace(url_encode(p_name), '+', '%20') AS export_url FROM part")
def url_build(s, d):
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return read(s, d, "part").select("p_partkey", X.wiki_url(F.lit("en"), title).alias("url"), X.export_url(F.lit("en"), F.col("p_name")).alias("export_url"))


@query("safe_component", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS component FROM pages")
def safe_component(s, d):
    return read(s, d, "pages").select("page_id", X.safe_component("url").alias("component"))


_NAMES = """n AS (SELECT 'P' || p_partkey AS qid, unnest([{'t': p_name, 's': 'en_name', 'i': 0}, {'t': p_brand, 's': 'en_aliases', 'i': 1}, {'t': p_name, 's': 'en_aliases', 'i': 2}, {'t': p_type, 's': 'enwiki_title', 'i': 3}]) AS x FROM part),
m AS (SELECT qid, 'en' AS language, x.t AS surface_text, x.s AS source, x.i AS source_index FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY surface_text, source, source_index) - 1 AS ordinal FROM m)"""


def _names(s, d):
    return surfaces.candidates(part_names(s, d), "en_name", "en_aliases", "enwiki_title", ("en_name", "en_aliases", "enwiki_title"), "en")


@query("surface_unpivot", f"WITH {_NAMES} SELECT * FROM m")
def surface_unpivot(s, d):
    return _names(s, d)


@query("surface_ordinals", f"WITH {_NAMES} SELECT *, qid || '_en_' || ordinal AS surface_id FROM o")
def surface_ordinals(s, d):
    return surfaces.ordinals(_names(s, d))


@query("surface_map", f"WITH {_NAMES} SELECT qid, language, string_agg(surface_text, '|' ORDER BY ordinal) AS surfaces FROM o GROUP BY 1, 2")
def surface_map(s, d):
    return surfaces.by_entity(surfaces.ordinals(_names(s, d))).select("qid", "language", F.array_join(F.transform("surfaces", lambda x: x["surface_text"]), "|").alias("surfaces"))


@query("surface_counts", f"WITH {_NAMES} SELECT language, source, count(*) AS n, count(DISTINCT qid) AS qids FROM o GROUP BY 1, 2")
def surface_counts(s, d):
    return surfaces.source_counts(_names(s, d))


# ---- recordings, audits, folds

_REC = """r AS (SELECT l_orderkey AS qid, l_partkey::VARCHAR AS id, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, id) AS n FROM r)"""


@query("recording_map", f"WITH {_REC} SELECT qid, count(*)::INT AS recording_count, string_agg(id, ',' ORDER BY pos, id) AS recording_ids FROM k GROUP BY 1")
def recording_map(s, d):
    return recordings.recording_map(pages_of_recordings(s, d)).select("qid", "recording_count", F.array_join("recording_ids", ",").alias("recording_ids"))


@query("recording_cap", f"WITH {_REC} SELECT qid, string_agg(id, ',' ORDER BY pos, id) AS recording_ids FROM k WHERE n <= 3 GROUP BY 1")
def recording_cap(s, d):
    return recordings.capped(recordings.recording_map(pages_of_recordings(s, d)), 3).select("qid", F.array_join("recording_ids", ",").alias("recording_ids"))


@query("recording_index", f"WITH {_REC} SELECT qid, id AS recording_id, 'https://xeno-canto.org/' || id || '/download' AS download_url, 'mp3' AS file_type FROM k")
def recording_index(s, d):
    return recordings.index(recordings.recording_map(pages_of_recordings(s, d)))


@query("recording_backfill", "SELECT o_orderkey AS qid, coalesce(c_mktsegment, '') AS xeno_canto_species_id FROM (SELECT DISTINCT l_orderkey FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey")
def recording_backfill(s, d):
    species = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("qid"), F.col("c_mktsegment").alias("xeno_canto_species_id"))
    got = recordings.recording_map(pages_of_recordings(s, d), species).join(read(s, d, "orders").select(F.col("o_orderkey").alias("qid")), "qid", "left_semi")
    return got.select("qid", "xeno_canto_species_id")


@query("recording_to_fetch", f"WITH {_REC} SELECT k.qid, id AS recording_id FROM k WHERE n <= 20 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = k.qid AND l.l_partkey::VARCHAR = k.id AND l_returnflag = 'R')")
def recording_to_fetch(s, d):
    have = read(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").cast("string").alias("recording_id")).distinct()
    return recordings.to_fetch(recordings.recording_map(pages_of_recordings(s, d)), have).select("qid", "recording_id")


_AUDIT = "a AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'valid' WHEN quality = 1 THEN 'repaired' WHEN toxic = 1 THEN 'repair_failed' ELSE 'invalid' END AS status FROM labels)"


def _audit(s, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return read(s, d, "labels").select("doc_id", recordings.audit_status(q & ~t, t, q).alias("status"))


@query("repair_audit", f"WITH {_AUDIT} SELECT count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status <> 'valid') AS invalid, count(*) FILTER (status = 'repaired') AS repaired, count(*) FILTER (status IN ('invalid', 'repair_failed')) AS failed FROM a")
def repair_audit(s, d):
    return recordings.audit_counts(_audit(s, d))


@query("repair_filter", f"WITH {_AUDIT} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a WHERE status NOT IN ('valid', 'repaired'))")
def repair_filter(s, d):
    return recordings.split_by_audit(read(s, d, "documents").select("doc_id", "source"), _audit(s, d), ["doc_id"])[0]


_FOLD = "f AS (SELECT o_custkey, o_orderkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0|' || o_custkey || '|' || o_orderkey), o_orderkey) - 1 AS pos FROM orders WINDOW w AS (PARTITION BY o_custkey)), g AS (SELECT o_custkey, o_orderkey, n = 1 AS train_only, CASE WHEN n > 1 THEN (pos % 5)::INT END AS fold_index FROM f)"


def _folds(s, d):
    return recordings.fold_assignment(read(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("folds", f"WITH {_FOLD} SELECT * FROM g")
def folds(s, d):
    return _folds(s, d)


@query("fold_splits", f"WITH {_FOLD} SELECT fold::INT AS fold, CASE WHEN fold_index = fold THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM g, generate_series(0, 4) x(fold) GROUP BY 1, 2")
def fold_splits(s, d):
    return recordings.fold_splits(_folds(s, d)).groupBy("fold", "split").agg(F.count("*").alias("n"))


@query("qid_split", "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('0|' || c_custkey), c_custkey::VARCHAR) AS pos, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN pos <= round_even(n * 0.2, 0) THEN 'test' WHEN pos <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'validation' ELSE 'train' END AS split FROM c")
def qid_split(s, d):
    return recordings.entity_split(read(s, d, "customer"), "c_custkey", 0.1, 0.2)


# ---- text


@query("markup_strip", r"SELECT page_id, length(t) AS n_chars, sha256(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?si)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)")
def markup_strip(s, d):
    t = read(s, d, "pages").select("page_id", X.markup_text("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query("sentence_split", r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([。．！？.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+')) AS x FROM documents), q AS (SELECT doc_id, trim(x, E' \t\n\r') AS x FROM p)
 SELECT doc_id, count(*) AS n, sum(length(x))::BIGINT AS chars FROM q WHERE length(x) >= 20 GROUP BY 1""")
def sentence_split(s, d):
    x = read(s, d, "documents").select("doc_id", F.transform(X.sentences("text"), F.length).alias("x"))
    return x.where("size(x) > 0").select("doc_id", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, n: a + n).alias("chars"))


@query("wiki_clean", r"""SELECT n_nationkey, n_name || ' is a thing; see ' || n_name || '.' AS plain FROM nation""")
def wiki_clean(s, d):
    n = F.col("n_name")
    raw = F.concat(F.lit("{{box|a}}'''"), n, F.lit("''' is a [[Some page|thing]]<ref name=x>y</ref>; [[File:a.png|b]] see [http://x.org/y "), n, F.lit("].\n{| class=t\n|}\n[[Category:Places]]"))
    return read(s, d, "nation").select("n_nationkey", X.wiki_text(raw).alias("plain")).withColumn("plain", F.regexp_replace("plain", r"\s+;", ";")).withColumn("plain", F.regexp_replace("plain", r"\s{2,}", " "))


# ---- vectors


@query("audio_windows", "WITH w AS (SELECT doc_id, n_chars AS n, unnest(generate_series(0, greatest(ceil((n_chars - 300) / 250.0), 0)::BIGINT)) AS i FROM documents WHERE n_chars > 0) SELECT doc_id, i::INT AS window_index, i * 250 / 100.0::DOUBLE AS start_seconds, least(i * 250 + 300, n) / 100.0::DOUBLE AS end_seconds, greatest(i * 250 + 300 - n, 0) AS pad FROM w")
def audio_windows(s, d):
    x = read(s, d, "documents").select("doc_id", "n_chars", F.lit(100).alias("rate"))
    return signals.windows(x, "n_chars", "rate", 3.0, 0.5).select("doc_id", "window_index", "start_seconds", "end_seconds", "pad")


def _paths(s, d):
    return vectors(s, d).withColumn("relative_path", F.concat("qid", F.lit("/"), F.floor(F.col("idx") / 10), F.lit(".mp3")))


@query("file_vector_mean", f"WITH {VEC}, x AS (SELECT qid, qid || '/' || (idx // 10) || '.mp3' AS relative_path, unnest(generate_series(0, 63)) AS pos, e FROM v) SELECT qid, relative_path, pos::INT AS pos, round(avg(e[pos + 1]), 6) AS x FROM x GROUP BY 1, 2, 3")
def file_vector_mean(s, d):
    return runs.file_vectors(_paths(s, d)).select("qid", "relative_path", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("first_vector", f"WITH {VEC} SELECT qid, min(idx) AS idx, round(list_sum(arg_min(e, idx)), 6) AS total FROM v GROUP BY 1")
def first_vector(s, d):
    return runs.first_vectors(vectors(s, d), ["idx"]).select("qid", "idx", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_RUNS = "m AS (SELECT l_returnflag AS run, 'P' || l_partkey AS qid, 'P' || l_partkey || '/' || l_suppkey AS relative_path FROM lineitem)"


def _members(s, d):
    p = F.concat(F.lit("P"), "l_partkey")
    return read(s, d, "lineitem").select(F.col("l_returnflag").alias("run"), p.alias("qid"), F.concat(p, F.lit("/"), "l_suppkey").alias("relative_path"))


@query("representative_file", f"WITH {_RUNS}, c AS (SELECT qid, relative_path FROM m GROUP BY 1, 2 HAVING count(DISTINCT run) = 3) SELECT qid, min(relative_path) AS relative_path FROM c GROUP BY 1")
def representative_file(s, d):
    return runs.representative_files(_members(s, d), 3)


@query("complete_ids", f"WITH {_RUNS} SELECT qid FROM m GROUP BY 1 HAVING count(DISTINCT run) = 3")
def complete_ids(s, d):
    return runs.complete_ids(_members(s, d), 3)


@query("run_summary", "SELECT label AS run, count(DISTINCT vec_id) AS qid_count, count(*) AS row_count, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim FROM embeddings GROUP BY 1")
def run_summary(s, d):
    return runs.summary(read(s, d, "embeddings").select(F.col("label").alias("run"), F.col("vec_id").alias("qid"), "embedding"))


@query("l2_norm", f"WITH {VEC} SELECT idx, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / greatest(sqrt(list_inner_product(e, e)), 1e-12), 6) AS first FROM v")
def l2_norm(s, d):
    return vectors(s, d).select("idx", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(V.l2_normalize(F.col("embedding")), 0), 6).alias("first"))


_SIM = f"{VEC}, p AS (SELECT a.idx AS q, b.idx AS c, a.qid AS qq, b.qid AS cq, CASE WHEN a.idx = b.idx THEN 1.0 ELSE round(list_cosine_similarity(a.e, b.e), 9) + 0.0 END AS sim FROM v a, v b)"


@query("cosine_matrix", f"WITH {_SIM} SELECT q, c, sim FROM p")
def cosine_matrix(s, d):
    return similarity.matrix(vectors(s, d))


@query("sim_histogram", f"WITH {_SIM} SELECT least(floor((sim + 1) * 40), 79)::INT AS bin, count(*) AS n FROM p WHERE q < c GROUP BY 1")
def sim_histogram(s, d):
    return similarity.histogram(similarity.matrix(vectors(s, d)))


def _retrieval(self_hit: bool) -> str:
    return f"""WITH {_SIM}, r AS (SELECT q, qq, (qq = cq)::INT AS rel, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rk FROM p {'' if self_hit else 'WHERE q <> c'}),
 h AS (SELECT *, sum(rel) OVER (PARTITION BY q ORDER BY rk) AS hits FROM r),
 i AS (SELECT k, sum(1 / log2(k + 1)) OVER (ORDER BY k) AS ideal FROM generate_series(1, 100) x(k)),
 m AS (SELECT q, any_value(qq) AS qid, count(*) AS relevant_count, avg(hits / rk) AS ap, 1.0::DOUBLE / min(rk) AS rr, sum(CASE WHEN rk <= 10 THEN 1 / log2(rk + 1) ELSE 0 END) AS g10,
 sum(CASE WHEN rk <= 50 THEN 1 / log2(rk + 1) ELSE 0 END) AS g50, sum(CASE WHEN rk <= 100 THEN 1 / log2(rk + 1) ELSE 0 END) AS g100 FROM h WHERE rel = 1 GROUP BY q),
 z AS (SELECT q, qid, relevant_count, ap AS average_precision, rr AS reciprocal_rank, g10 / a.ideal AS ndcg_10, g50 / b.ideal AS ndcg_50, g100 / c.ideal AS ndcg_100 FROM m
 JOIN i a ON a.k = least(relevant_count, 10) JOIN i b ON b.k = least(relevant_count, 50) JOIN i c ON c.k = least(relevant_count, 100))"""


_M = ["average_precision", "reciprocal_rank", "ndcg_10", "ndcg_50", "ndcg_100"]


@query("retrieval_per_query", _retrieval(False) + " SELECT q, qid, relevant_count, " + ", ".join(f"round({m}, 6) AS {m}" for m in _M) + " FROM z")
def retrieval_per_query(s, d):
    v = vectors(s, d)
    x = similarity.metrics(v, v)
    return x.select("q", "qid", "relevant_count", *[F.round(m, 6).alias(m) for m in _M])


_MEANS = " SELECT (SELECT count(*) FROM v) AS sample_count, (SELECT count(*) FROM v) AS query_count, count(*) AS evaluated_query_count, round(avg(average_precision), 6) AS map, round(avg(reciprocal_rank), 6) AS mrr, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _M[2:]) + " FROM z"


def _means(s, d, self_hit):
    v = vectors(s, d)
    n = v.count()
    x = similarity.summary(similarity.metrics(v, v, self_hit), n, n)
    return x.select("sample_count", "query_count", "evaluated_query_count", *[F.round(m, 6).alias(m) for m in ("map", "mrr", *_M[2:])])


@query("retrieval_metrics", _retrieval(False) + _MEANS)
def retrieval_metrics(s, d):
    return _means(s, d, False)


@query("retrieval_self_hit", _retrieval(True) + _MEANS)
def retrieval_self_hit(s, d):
    return _means(s, d, True)


@query("concat_features", f"WITH {VEC}, f AS (SELECT qid, arg_min(e, idx) AS a, arg_max(e, idx) AS b FROM v GROUP BY 1) SELECT qid, len(a || b)::INT AS dims, round(list_sum(a || b), 6) AS total FROM f")
def concat_features(s, d):
    v = vectors(s, d)
    w = Window.partitionBy("qid").orderBy(F.desc("idx"))
    last = v.withColumn("n", F.row_number().over(w)).where("n = 1").select("qid", F.col("embedding").alias("b"))
    x = runs.first_vectors(v, ["idx"]).join(last, "qid").select("qid", F.concat("embedding", "b").alias("x"))
    return x.select("qid", F.size("x").alias("dims"), F.round(F.aggregate("x", F.lit(0.0), lambda a, y: a + y), 6).alias("total"))


_EXP = f"""{VEC}, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idx) AS k FROM v),
x AS (SELECT g.qid, g.idx AS gi, a.idx AS ai, l.idx AS li, list_sum(g.e || a.e || l.e) AS total FROM n g JOIN n a USING (qid) JOIN n l USING (qid) WHERE g.k = 1 AND a.k <= 4 AND l.k <= 3)"""


@query("sample_expand", f"WITH {_EXP} SELECT qid || '__' || lpad((row_number() OVER (ORDER BY qid, gi, ai, li) - 1)::VARCHAR, 6, '0') AS sample_id, qid, 'X' || qid AS label_qid, 'graph+audio+language' AS modality_pattern, round(total, 6) AS total FROM x")
def sample_expand(s, d):
    v = vectors(s, d).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("idx")))
    labels = v.select("qid").distinct().select("qid", F.concat(F.lit("X"), "qid").alias("label_qid"))
    x = classify.expand(labels, {"graph": v.where("k = 1"), "audio": v.where("k <= 4"), "language": v.where("k <= 3")})
    return x.select("sample_id", "qid", "label_qid", "modality_pattern", F.round(F.aggregate("features", F.lit(0.0), lambda a, y: a + y), 6).alias("total"))


@query("sample_expand_all")
def sample_expand_all(s, d):
    """As sample_expand, but every vector of a label of three or more is dealt to a modality: the first is shared, and up to four
    meet all others, so samples grow with vectors."""
    v = vectors(s, d).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("idx")))
    labels = v.select("qid").distinct().select("qid", F.concat(F.lit("X"), "qid").alias("label_qid"))
    audio = "k % 2 = 0 and k <= 8"
    x = classify.expand(labels, {"graph": v.where("k = 1"), "audio": v.where(audio), "language": v.where(f"k > 1 and not ({audio})")})
    return x.select("sample_id", "qid", "label_qid", "modality_pattern", F.round(F.aggregate("features", F.lit(0.0), lambda a, y: a + y), 6).alias("total"))


@query("standardize", f"WITH {VEC}, x AS (SELECT unnest(generate_series(0, 63)) AS pos, e FROM v) SELECT pos::INT AS pos, round(avg(e[pos + 1]), 6) AS mean, round(CASE WHEN stddev_pop(e[pos + 1]) = 0 THEN 1 ELSE stddev_pop(e[pos + 1]) END, 6) AS scale FROM x GROUP BY 1")
def standardize(s, d):
    return classify.standardized(vectors(s, d), "embedding").select("pos", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("transe_score", f"WITH {VEC} SELECT h.idx, round(list_sum(list_transform(generate_series(1, 64), lambda i: abs(h.e[i] + 0.01 - t.e[i]))), 6) AS distance FROM v h JOIN v t ON t.idx = h.idx + 1")
def transe_score(s, d):
    v = vectors(s, d)
    t = v.select((F.col("idx") - 1).alias("idx"), F.col("embedding").alias("t"))
    r = F.array_repeat(F.lit(0.01), 64)
    return v.join(t, "idx").select("idx", F.round(embedding.transe_distance(F.col("embedding"), r, F.col("t")), 6).alias("distance"))


# ---- evaluation

_CL = f"{VEC}, k AS (SELECT qid AS t, list_position(e, list_max(e)) - 1 AS p FROM v), cells AS (SELECT t, p, count(*) AS n FROM k GROUP BY 1, 2)"


def _clusters(s, d):
    return vectors(s, d).withColumn("cluster", V.argmax(F.col("embedding")))


@query("contingency", f"WITH {_CL} SELECT t, p::INT AS p, n FROM cells")
def contingency(s, d):
    return clustering.contingency(_clusters(s, d), "qid", "cluster")


@query(
    "cluster_metrics",
    f"""WITH {_CL}, r AS (SELECT t, sum(n) AS a FROM cells GROUP BY 1), c AS (SELECT p, sum(n) AS b, max(n) AS top FROM cells GROUP BY 1), z AS (SELECT sum(n)::DOUBLE AS total, sum(n * (n - 1) / 2) AS sn FROM cells),
 x AS (SELECT total, sn, (SELECT -sum(a / total * ln(a / total)) FROM r) AS ht, (SELECT -sum(b / total * ln(b / total)) FROM c) AS hp, (SELECT sum(top) FROM c) AS top, (SELECT sum(a * (a - 1) / 2) FROM r) AS sa, (SELECT sum(b * (b - 1) / 2) FROM c) AS sb,
 (SELECT sum(n / total * ln(n * total / (a * b))) FROM cells JOIN r USING (t) JOIN c USING (p)) AS mi FROM z)
 SELECT round(mi / sqrt(ht * hp), 6) AS nmi, round(mi / ht, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 6) AS v_measure, round(top / total, 6) AS purity,
 round((sn - sa * sb / (total * (total - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (total * (total - 1) / 2)), 6) AS ari FROM x""",
)
def cluster_metrics(s, d):
    x = clustering.scores(clustering.contingency(_clusters(s, d), "qid", "cluster"))
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


@query(
    "silhouette_sample",
    f"""WITH {VEC}, k AS (SELECT idx, qid AS k, e FROM v ORDER BY md5(idx::VARCHAR), idx LIMIT 2000), s AS (SELECT a.idx, a.k, b.k AS o, sum(list_distance(a.e, b.e)) AS t, count(*) AS n FROM k a, k b GROUP BY 1, 2, 3),
 m AS (SELECT idx, coalesce(max(CASE WHEN k = o THEN CASE WHEN n > 1 THEN t / (n - 1) ELSE 0 END END), 0) AS a, min(CASE WHEN k <> o THEN t / n END) AS b FROM s GROUP BY 1)
 SELECT count(*) AS sample_count, round(avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""",
)
def silhouette_sample(s, d):
    return clustering.silhouette(vectors(s, d), "qid").select("sample_count", F.round("silhouette", 6).alias("silhouette"))


_METHODS = "e AS (SELECT event_type AS method, round(avg(value), 6) AS m1, max(value) AS m2, count(*)::DOUBLE AS m3 FROM events GROUP BY 1)"


def _methods(s, d):
    return read(s, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.round(F.avg("value"), 6).alias("m1"), F.max("value").alias("m2"), F.count("*").cast("double").alias("m3"))


@query("metric_ranks", f"WITH {_METHODS}, r AS (SELECT method, row_number() OVER (ORDER BY m1 DESC, method)::INT AS rank_m1, row_number() OVER (ORDER BY m2 DESC, method)::INT AS rank_m2, row_number() OVER (ORDER BY m3 DESC, method)::INT AS rank_m3 FROM e) SELECT *, (rank_m1 + rank_m2 + rank_m3) / 3.0::DOUBLE AS mean_rank, (rank_m1 = 1)::INT + (rank_m2 = 1)::INT + (rank_m3 = 1)::INT AS best_metric_count FROM r")
def metric_ranks(s, d):
    return clustering.ranks(_methods(s, d), ["m1", "m2", "m3"], order="method")


_REP = """p AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t, CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END AS p FROM labels), l AS (SELECT t AS label FROM p UNION SELECT p FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE t = label) AS support, (SELECT count(*) FROM p WHERE t = label AND p.p = label) AS tp, (SELECT count(*) FROM p WHERE p.p = label) AS predicted FROM l),
r AS (SELECT label, support, tp, predicted - tp AS fp, support - tp AS fn, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)"""


def _predictions(s, d):
    name = lambda c: F.when(c, "good").otherwise("bad")
    return read(s, d, "labels").select(name(F.col("quality") == 1).alias("true_label"), name(F.col("toxic") == 0).alias("predicted_label"))


@query("class_report", f"WITH {_REP} SELECT label, support, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_report(s, d):
    x = classify.class_report(_predictions(s, d))
    return x.select("label", "support", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("class_overall", f"WITH {_REP} SELECT sum(support)::BIGINT AS row_count, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def class_overall(s, d):
    x = classify.overall(classify.class_report(_predictions(s, d)))
    return x.select("row_count", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("context_pairs", "WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT a.user_id, a.event_id, a.event_type AS center, b.event_type AS context, (b.n - a.n)::INT AS offset FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.n - b.n) BETWEEN 1 AND 2")
def context_pairs(s, d):
    return embedding.context_pairs(read(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 2)


@query("resume_left_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def resume_left_anti(s, d):
    li = read(s, d, "lineitem")
    key = lambda c: li.where(c).select(F.col("l_orderkey").alias("o_orderkey"))
    return resume.remaining(read(s, d, "orders").select("o_orderkey"), key("l_returnflag = 'R'"), ["o_orderkey"], key("l_quantity > 49"))


@query("latest_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins(s, d):
    return resume.latest_wins(read(s, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("latest_run", "SELECT lang, max(source) AS source FROM documents GROUP BY 1")
def latest_run(s, d):
    return runs.latest(read(s, d, "documents"), ["lang"], "source")


@query("dataset_summary", "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('0|' || c_custkey), c_custkey::VARCHAR) AS pos, count(*) OVER () AS n FROM customer), s AS (SELECT c_custkey, CASE WHEN pos <= round_even(n * 0.2, 0) THEN 'test' WHEN pos <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'validation' ELSE 'train' END AS split FROM c) SELECT split, count(*) AS row_count, count(DISTINCT o_custkey) AS qid_count FROM orders JOIN s ON c_custkey = o_custkey GROUP BY 1")
def dataset_summary(s, d):
    split = recordings.entity_split(read(s, d, "customer"), "c_custkey", 0.1, 0.2)
    x = read(s, d, "orders").join(split, F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy("split").agg(F.count("*").alias("row_count"), F.countDistinct("o_custkey").alias("qid_count"))


# ---- trained models: rows only


@query("node2vec_walks")
def node2vec_walks(s, d):
    return embedding.walks(graph.neighbor_map(_tax(s, d)[1]), length=6, per_node=1, p=0.5, q=2.0)


@query("kmeans_eval")
def kmeans_eval(s, d):
    x = clustering.kmeans(vectors(s, d), 10)
    return clustering.scores(clustering.contingency(x, "qid", "cluster"))


@query("softmax_train")
def softmax_train(s, d):
    return classify.softmax_regression(vectors(s, d).select(F.col("embedding").alias("features"), F.col("qid").alias("label_qid")), epochs=20)[1]


@query("transe_train")
def transe_train(s, d):
    nodes, edges = _tax(s, d)
    return embedding.transe(edges, size=128, epochs=200)[1]


@query("negative_edges")
def negative_edges(s, d):
    nodes, edges = _tax(s, d)
    return embedding.negative_edges(edges, nodes)


from . import more  # noqa: E402, F401  the queries there are added to the same catalog

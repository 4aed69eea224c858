"""The taxonomy graph: nodes(qid, parent, label, rank, ...) and edges(parent_qid, child_qid, relation).

Walks are loops over levels, each a join; what they carry is written to the shared folder every few levels, so neither plans
nor recursion limits grow with the depth. A path is carried along, so that cycles end.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, or_else, py_strip
from ..plans.staging import staged

RELATION = "parent taxon"
#: Rank items and their English names, for graphs whose rank names are missing.
RANK_NAMES = {
    "Q68947": "subspecies", "Q7432": "species", "Q34740": "genus", "Q35409": "family", "Q164280": "subfamily", "Q227936": "tribe",
    "Q2136103": "superfamily", "Q36602": "order", "Q37517": "class", "Q5867959": "suborder", "Q2889003": "infraorder", "Q5867051": "subclass",
    "Q6311258": "parvorder", "Q3238261": "subgenus", "Q5868144": "superorder", "Q279749": "form", "Q2007442": "infraclass", "Q112082101": "ichnogenus",
}
#: Ranks from the top down.
RANK_ORDER = [
    "class", "subclass", "infraclass", "superorder", "order", "suborder", "infraorder", "parvorder", "superfamily", "family",
    "subfamily", "tribe", "genus", "subgenus", "species", "subspecies", "form", "ichnogenus", "unknown",
]


def build_nodes(rows: DataFrame) -> DataFrame:
    """Node attributes with fallbacks; of rows that share an id the last (by `pos`) counts; blank ids go."""
    key = or_else(py_strip("qid"), py_strip("id")) if "id" in rows.columns else py_strip("qid")
    keyed = rows.withColumn("qid", key).where("qid <> ''")
    order = F.desc("pos") if "pos" in rows.columns else F.desc("parent_taxon")
    last = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("qid").orderBy(order))).where("__n = 1")
    return last.select("qid", or_else(py_strip("en_name"), py_strip("taxon_name"), F.col("qid")).alias("label_en"), py_strip("taxon_rank_name").alias("taxon_rank_name"), py_strip("parent_taxon").alias("parent_taxon"))


def build_edges(nodes: DataFrame) -> DataFrame:
    """One edge for each parent and child; blank parents give none."""
    return nodes.where(blank("parent_taxon") != "").select(F.col("parent_taxon").alias("parent_qid"), F.col("qid").alias("child_qid"), F.lit(RELATION).alias("relation")).distinct()


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents that edges name and nodes lack: with their id as label and nothing else."""
    missing = edges.select(F.col("parent_qid").alias("qid")).distinct().join(nodes.select("qid"), "qid", "left_anti")
    return missing.select("qid", F.col("qid").alias("label_en"), F.lit("").alias("taxon_rank_name"), F.lit("").alias("parent_taxon"))


def build_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = build_nodes(rows)
    edges = build_edges(nodes)
    return nodes.unionByName(placeholders(nodes, edges)), edges


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent or child is no node: the foreign keys that a store would refuse."""
    ids = nodes.select(F.col("qid").alias("k"))
    return edges.join(ids, F.col("parent_qid") == F.col("k"), "left_anti").union(edges.join(ids, F.col("child_qid") == F.col("k"), "left_anti")).distinct()


def children(nodes: DataFrame, edges: DataFrame, parent: str) -> DataFrame:
    return edges.where(F.col("parent_qid") == parent).select(F.col("child_qid").alias("qid")).join(nodes, "qid").select(*nodes.columns).orderBy("qid")


def descendants(nodes: DataFrame, edges: DataFrame, root: str, max_depth: int | None = None, stage_every: int = 4) -> DataFrame:
    """The root and what is below it, with depth: once for each path, cycles end. max_depth 0 gives the root only. Levels are written
    and joined `stage_every` at a time; a written stretch that has no row ends the walk."""
    level = nodes.where(F.col("qid") == root).select("qid", F.lit(0).alias("depth"), F.array("qid").alias("__path"))
    out, here, step = [level], [], 0
    e = edges.select(F.col("parent_qid").alias("__p"), F.col("child_qid").alias("__c"))
    known = nodes.select(F.col("qid").alias("__c"))
    e = e.join(known, "__c", "left_semi")
    if max_depth is None or max_depth > 2:
        e = staged(e, "edges")  # each level joins with it
    while max_depth is None or step < max_depth:
        step += 1
        level = level.join(e, F.col("qid") == F.col("__p")).where(~F.array_contains("__path", F.col("__c"))).select(F.col("__c").alias("qid"), (F.col("depth") + 1).alias("depth"), F.array_append("__path", F.col("__c")).alias("__path"))
        here.append(level)
        if step % stage_every == 0 or step == max_depth:
            # all levels of the stretch in one table, from which the next goes on
            rows = staged(functools.reduce(DataFrame.union, here), "level")
            out.append(rows)
            level, here = rows.where(F.col("depth") == step), []
            if step != max_depth and level.isEmpty():
                break
    return functools.reduce(DataFrame.union, out).drop("__path")


def closure(nodes: DataFrame, parent: str = "parent_taxon", max_levels: int | None = None, stage_every: int = 4) -> DataFrame:
    """(qid, ancestor, distance) of every node, by the parent attribute: chains end at a missing node or a cycle; self is
    left out. Starts from every node, since a real taxonomy is a forest."""
    up = staged(nodes.select(F.col("qid").alias("__q"), F.col(parent).alias("__up")), "parents")
    level = up.select(F.col("__q").alias("qid"), F.col("__q").alias("ancestor"), F.lit(0).alias("distance"), F.col("__up").alias("__next"), F.array("__q").alias("__seen"))
    out, here, step = [], [], 0
    while max_levels is None or step < max_levels:
        step += 1
        level = level.where((blank("__next") != "") & ~F.array_contains("__seen", F.col("__next"))).select("qid", F.col("__next").alias("__q"), (F.col("distance") + 1).alias("distance"), "__seen").join(up, "__q")
        level = level.select("qid", F.col("__q").alias("ancestor"), "distance", F.col("__up").alias("__next"), F.array_append("__seen", F.col("__q")).alias("__seen"))
        here.append(level)
        if step % stage_every == 0 or step == max_levels:
            # all levels of the stretch in one table, from which the next goes on
            rows = staged(functools.reduce(DataFrame.union, here), "closure")
            out.append(rows)
            level, here = rows.where(F.col("distance") == step), []
            if step != max_levels and level.isEmpty():
                break
    return functools.reduce(DataFrame.union, out or [level.where("false")]).select("qid", "ancestor", "distance")


def paths(nodes: DataFrame, ancestors: DataFrame, root: str, parent: str = "parent_taxon") -> DataFrame:
    """`/root/.../qid`: up to the root, a parent that isn't there (its id is still named) or a cycle."""
    chain = ancestors.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))).alias("c"))
    ids = F.transform("c", lambda x: x["ancestor"])
    at = F.array_position(ids, F.lit(root)).cast("int")
    upward = F.when(F.col("qid") == root, F.array().cast("array<string>")).otherwise(F.coalesce(F.when(at > 0, F.slice(ids, F.lit(1), F.greatest(at, F.lit(1)))).otherwise(ids), F.array().cast("array<string>")))
    return nodes.select("qid").join(chain, "qid", "left").select("qid", F.concat(F.lit("/"), F.array_join(F.concat(F.reverse(upward), F.array("qid")), "/")).alias("path"))


def nearest_of_rank(nodes: DataFrame, ancestors: DataFrame, rank: str, rank_col: str = "taxon_rank_name", label_col: str = "label_en") -> DataFrame:
    """For each node its nearest ancestor of a rank; nodes without one are left out."""
    named = nodes.where(F.replace(F.lower(py_strip(rank_col)), F.lit("_"), F.lit(" ")) == rank).select(F.col("qid").alias("ancestor"), F.col(label_col).alias("label_name"))
    best = ancestors.join(named, "ancestor").groupBy("qid").agg(F.min(F.struct("distance", "ancestor", "label_name")).alias("b"))
    return best.select("qid", F.lit(rank).alias("target_rank"), F.col("b.ancestor").alias("label_qid"), F.col("b.label_name").alias("label_name"), F.col("b.distance").alias("distance_to_label"))


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("parent_qid").alias("qid")).distinct(), "qid", "left_anti")


def subtree_sizes(nodes: DataFrame, edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Strict descendants and leaf descendants of every node."""
    leaf = leaves(nodes, edges).select("qid", F.lit(1).alias("leaf"))
    n = ancestors.join(leaf, "qid", "left").groupBy("ancestor").agg(F.count("*").alias("n"), F.sum("leaf").alias("l"))  # a node has an ancestor once
    zero = lambda c, to: F.coalesce(F.col(c), F.lit(0)).alias(to)
    return nodes.join(n.withColumnRenamed("ancestor", "qid"), "qid", "left").select(*nodes.columns, zero("n", "assigned_node_count"), zero("l", "assigned_leaf_node_count"))


def subtree_summary(detail: DataFrame, rank_col: str) -> DataFrame:
    """Statistics of subtree sizes by rank, as text with two decimals where they are means or medians."""
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    n, leaf = "assigned_node_count", "assigned_leaf_node_count"
    return detail.groupBy(rank_col).agg(
        F.count("*").alias("label_count"), two(F.avg(n)).alias("mean_nodes"), two(F.median(n)).alias("median_nodes"), F.max(n).alias("max_nodes"), F.min(n).alias("min_nodes"),
        two(F.avg(leaf)).alias("mean_leaves"), two(F.median(leaf)).alias("median_leaves"), F.max(leaf).alias("max_leaves"), F.count_if(F.col(n) == 0).alias("zero_label_count"),
    )


def bounded_bfs(nodes: DataFrame, edges: DataFrame, root: str, max_depth: int, max_nodes: int) -> DataFrame:
    """Breadth-first from root, children in the order of ids, no node twice, at most max_nodes: qid, depth, position. What is
    carried is bounded by max_nodes."""
    seen = nodes.where(F.col("qid") == root).select("qid", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("position")).limit(max_nodes)
    level = seen
    e = edges.join(nodes.select(F.col("qid").alias("child_qid")), "child_qid", "left_semi")
    for depth in range(1, max_depth + 1):
        # a node belongs to its first parent in the order of the level before
        new = level.select("qid", "position").join(e, F.col("qid") == F.col("parent_qid")).groupBy("child_qid").agg(F.min("position").alias("pp")).join(seen.select(F.col("qid").alias("child_qid")), "child_qid", "left_anti")
        level = new.orderBy("pp", "child_qid").limit(max_nodes)
        w = Window.orderBy("pp", "child_qid")  # of at most max_nodes rows
        level = level.select(F.col("child_qid").alias("qid"), F.lit(depth).alias("depth"), (F.row_number().over(w) + F.lit(depth) * max_nodes).cast("long").alias("position"))
        seen = staged(seen.union(level).orderBy("position").limit(max_nodes), "bfs")
        level = seen.where(F.col("depth") == depth)
    return seen


def subgraph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between kept nodes."""
    ids = kept.select("qid")
    return edges.join(ids.withColumnRenamed("qid", "parent_qid"), "parent_qid", "left_semi").join(ids.withColumnRenamed("qid", "child_qid"), "child_qid", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """Neighbours without direction."""
    return edges.select(F.col("parent_qid").alias("qid"), F.col("child_qid").alias("neighbor")).union(edges.select("child_qid", "parent_qid")).distinct()


def neighbor_map(edges: DataFrame, directed: bool = False) -> DataFrame:
    pairs = edges.select(F.col("parent_qid").alias("qid"), F.col("child_qid").alias("neighbor")) if directed else both_ways(edges)
    return pairs.groupBy("qid").agg(F.sort_array(F.collect_set("neighbor")).alias("neighbors"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("parent_qid").alias("qid"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("child_qid", F.lit(0), F.lit(1)))
    d = ends.groupBy("qid").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return nodes.select("qid").join(d, "qid", "left").select("qid", z("in_degree").alias("in_degree"), z("out_degree").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees over their maxima, and the log degree over its maximum; a maximum of 0 counts as 1."""
    d = degrees(nodes, edges)
    top = d.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"m_{c}") for c in ("degree", "in_degree", "out_degree")])
    x = d.crossJoin(F.broadcast(top))  # one row
    return x.select("qid", (F.col("degree") / F.col("m_degree")).alias("f_degree"), (F.col("in_degree") / F.col("m_in_degree")).alias("f_in"), (F.col("out_degree") / F.col("m_out_degree")).alias("f_out"), (F.log1p("degree") / F.log1p("m_degree")).alias("f_log"))


def noise_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree (at least 1) to the power 0.75, as shares."""
    w = degrees(nodes, edges).select("qid", F.pow(F.greatest("degree", F.lit(1)).cast("double"), 0.75).alias("w"))
    total = w.agg(F.sum("w").alias("t"))
    return w.crossJoin(F.broadcast(total)).select("qid", (F.col("w") / F.col("t")).alias("weight"))  # one row


def adjacency(nodes: DataFrame, edges: DataFrame, symmetric: bool = False) -> DataFrame:
    """Entries of the normalized adjacency with self-loops: by row, or by both square roots of the row sums."""
    e = both_ways(edges).select(F.col("qid").alias("src"), F.col("neighbor").alias("dst")).union(nodes.select("qid", "qid"))
    d = e.groupBy("src").agg(F.count("*").alias("d"))
    out = e.join(d, "src")
    if not symmetric:
        return out.select("src", "dst", (F.lit(1.0) / F.col("d")).alias("weight"))
    return out.join(d.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (F.lit(1.0) / F.sqrt(F.col("d") * F.col("e").cast("double"))).alias("weight"))


def propagate(adj: DataFrame, features: DataFrame, cols: list[str]) -> DataFrame:
    """One step of message passing: weighted sums of the neighbours' features."""
    x = adj.join(features.withColumnRenamed("qid", "dst"), "dst")
    return x.groupBy(F.col("src").alias("qid")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in cols])


def rank_counts(nodes: DataFrame, rank_col: str = "taxon_rank_name", item_col: str | None = None) -> DataFrame:
    """Counts by rank, most first; a blank rank name is looked up by its item."""
    item = or_else(py_strip(item_col) if item_col else F.lit(""), F.lit("unknown"))
    known = F.create_map(*[F.lit(x) for kv in RANK_NAMES.items() for x in kv])
    own, looked = py_strip(rank_col), F.try_element_at(known, item)
    source = F.when(own != "", "graph").when(looked.isNotNull(), "fallback_wikidata").otherwise("unknown")
    return nodes.groupBy(item.alias("taxon_rank_qid"), or_else(own, looked, F.lit("unknown")).alias("taxon_rank_name"), source.alias("name_source")).agg(F.count("*").alias("node_count")).orderBy(F.desc("node_count"), "taxon_rank_qid", "taxon_rank_name")


def in_rank_order(detail: DataFrame, rank_col: str, count_col: str, id_col: str) -> DataFrame:
    """From the top rank down, then most first; ranks that aren't known last."""
    order = F.array(*[F.lit(r) for r in RANK_ORDER])
    at = F.array_position(order, F.col(rank_col))
    return detail.orderBy(F.when(at == 0, F.lit(len(RANK_ORDER) + 1)).otherwise(at), F.desc(count_col), id_col)


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON elements of a graph viewer."""
    n = nodes.select(F.concat(F.lit("n:"), "qid").alias("element_id"), F.to_json(F.struct(F.col("qid").alias("id"), F.col("label_en").alias("label"))).alias("data"))
    e = edges.select(F.concat_ws("", F.lit("e:"), "parent_qid", F.lit("->"), "child_qid").alias("element_id"), F.to_json(F.struct(F.col("parent_qid").alias("source"), F.col("child_qid").alias("target"))).alias("data"))
    return n.unionByName(e)

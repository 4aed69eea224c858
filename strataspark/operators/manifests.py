"""Lists and manifests that steps hand to each other: ids, targets, examples, articles, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, export_url, last_segment, or_else, py_strip
from .graph import leaves
from .recordings import first_seen


def id_list(items: DataFrame, url_col: str, order: str, root: str | None = None) -> DataFrame:
    """(qid, pos): the ids that URLs end in, each once where first seen; the root stands first unless it is there."""
    x = items.select(py_strip(last_segment(url_col)).alias("qid"), F.col(order).cast("long").alias("pos")).where("qid <> ''")
    one = first_seen(x, ["qid"], ["pos"])
    return one if root is None else with_root(one, root)


def with_root(ids: DataFrame, root: str) -> DataFrame:
    """The root ahead of all, unless it is among them."""
    first = ids.sparkSession.range(1).select(F.lit(root).alias("qid"))
    return first.join(ids.select("qid"), "qid", "left_anti").select("qid", F.lit(-1).cast("long").alias("pos")).union(ids.select("qid", "pos"))


def leaf_targets(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows whose id and species id aren't blank and whose id is a leaf."""
    ok = rows.withColumn("qid", py_strip("qid")).where((F.col("qid") != "") & (py_strip("xeno_canto_species_id") != ""))
    return ok.join(leaves(nodes, edges).select("qid"), "qid", "left_semi")


def leaf_rows(nodes: DataFrame, edges: DataFrame, ontology: DataFrame) -> DataFrame:
    """Each leaf with its ontology row, where there is one."""
    return leaves(nodes, edges).select("qid").join(ontology, "qid", "left")


def all_ids(*tables: DataFrame) -> DataFrame:
    """The ids that any of the tables has."""
    out = tables[0].select("qid")
    for t in tables[1:]:
        out = out.union(t.select("qid"))
    return out.distinct()


def only_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of certain ids, as they were."""
    return rows.join(ids.select("qid").distinct(), "qid", "left_semi")


def label_of(assignments: DataFrame, order: str) -> DataFrame:
    """Each id's label: the last that it was given."""
    return assignments.groupBy("qid").agg(F.max_by("label_qid", order).alias("label_qid"))


def example_manifest(examples: DataFrame) -> DataFrame:
    """Examples as text, in the order of id and path: no fold is blank, yes and no are 1 and 0."""
    flag = F.when(F.coalesce(F.col("train_only_all_folds"), F.lit(False)), "1").otherwise("0")
    more = [blank(c).alias(c) for c in ("recording_id", "audio_path", "relative_path")]
    return examples.select("qid", *more, blank(F.col("fold_index").cast("string")).alias("fold_index"), flag.alias("train_only_all_folds"), *[blank(c).alias(c) for c in ("xeno_canto_species_id", "download_url")]).orderBy("qid", "relative_path")


def article_manifest(titles: DataFrame, language: str, xml_dir: str, text_dir: str) -> DataFrame:
    """Where each article (qid, title) comes from and goes to; blank ids and titles are left out."""
    t = titles.select(py_strip("qid").alias("qid"), py_strip("title").alias("title")).where("qid <> '' and title <> ''")
    file = lambda d, suffix: F.concat(F.lit(f"{d.rstrip('/')}/"), "qid", F.lit(suffix))
    return t.select("qid", F.lit(language).alias("language"), "title", export_url(F.lit(language), F.col("title")).alias("xml_url"), file(xml_dir, ".xml").alias("xml_output_path"), file(text_dir, ".txt").alias("text_output_path"))


def rank_rows(counts: DataFrame) -> DataFrame:
    """A rank distribution as text, most first."""
    return counts.orderBy(F.desc("node_count"), "taxon_rank_qid", "taxon_rank_name").select("taxon_rank_qid", "taxon_rank_name", "name_source", F.col("node_count").cast("string").alias("node_count"))


def recordings_from_rows(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """A recording map from a flat table (qid, xeno_canto_species_id, recording_id, download_url): one row for each id and species, with
    recordings in the table's order."""
    x = rows.where((py_strip("qid") != "") & (py_strip("recording_id") != ""))
    got = x.groupBy(py_strip("qid").alias("qid"), blank("xeno_canto_species_id").alias("xeno_canto_species_id")).agg(F.array_sort(F.collect_list(F.struct(order, py_strip("recording_id").alias("id"), blank("download_url").alias("url")))).alias("r"))
    return got.select("qid", "xeno_canto_species_id", F.size("r").alias("recording_count"), F.transform("r", lambda x: x["id"]).alias("recording_ids"), F.transform("r", lambda x: x["url"]).alias("download_urls"))


def existing_files(listing: DataFrame, root: str, path_col: str = "path", size_col: str = "length") -> DataFrame:
    """(qid, recording_id, path, size) of the files of a listing below root/id; temporary ones are left out."""
    rel = F.regexp_replace(F.col(path_col), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    ok = listing.where((F.size(parts) >= 2) & ~F.endswith(name, F.lit(".tmp")) & (name != "existing_audio_manifest.json"))
    return ok.select(F.element_at(parts, 1).alias("qid"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("recording_id"), rel.alias("path"), F.col(size_col).cast("long").alias("size"))


def fetch_summary(status: DataFrame, ok: str = "ok") -> DataFrame:
    """One row: how many ids, how many went well and failed, and the first 50 that failed."""
    bad = F.when(F.col("status") != ok, F.col("qid"))
    counts = status.agg(F.count("*").alias("target_qid_count"), F.count_if(F.col("status") == ok).alias("saved_qid_count"), F.count(bad).alias("failed_qid_count"))
    first = status.where(F.col("status") != ok).orderBy("qid").limit(50).agg(F.array_sort(F.collect_list("qid")).alias("failed_qids"))
    return counts.crossJoin(first)  # one row each


def first_missing(missing: DataFrame, n: int = 20, key: str = "qid") -> DataFrame:
    return missing.select(key).distinct().orderBy(key).limit(n)


def capped_ids(rows: DataFrame, n: int, key: str = "qid") -> DataFrame:
    """Rows of the first n ids."""
    return rows.join(first_missing(rows, n, key), key, "left_semi")


def capped_rows(rows: DataFrame, n: int, order: list[str], key: str = "qid") -> DataFrame:
    """The first rows of each id: n, but one at least."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(1, n)).drop("__n")


def by_language(*manifests: DataFrame) -> DataFrame:
    """Manifests of several languages as one, ordered by language and surface."""
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m)
    return out.orderBy("language", "surface_id")


def json_text(c: Column) -> Column:
    """Text as it is, anything else as JSON."""
    return F.to_json(c)


def point(rows: DataFrame, value: str, key: str = "qid") -> DataFrame:
    """The row of a key."""
    return rows.where(F.col(key) == value)


def edge_indexes(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(head, tail): edges as positions of their ends among all ids in order; both ways, if not directed. Positions come from counts by
    the ids' hash bins, in order within each, so no task sorts all."""
    bins = nodes.select("qid").distinct().withColumn("bin", F.substring("qid", 1, 3))
    sizes = bins.groupBy("bin").agg(F.count("*").alias("n"))
    before = sizes.select("bin", (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("before"))  # one row for each beginning of an id
    at = bins.join(F.broadcast(before), "bin").select("qid", (F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("qid")) - 1).alias("at"))
    pairs = edges.select("parent_qid", "child_qid")
    if not directed:
        pairs = pairs.union(edges.select("child_qid", "parent_qid")).distinct()
    return pairs.join(at.toDF("parent_qid", "head"), "parent_qid").join(at.toDF("child_qid", "tail"), "child_qid").select("head", "tail")


# ---- draws that any engine can repeat


def draw(*cols: Column | str, below: Column | int) -> Column:
    """A whole number below a bound, from the first 60 bits of an MD5."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % (F.lit(below) if isinstance(below, int) else below)


def layered(neighbors: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """(qid, layer, neighbors): for each fan-out a sample of each node's list and the node itself, sorted; a later layer samples from the lists
    of the one before. neighbors: (qid, neighbors), an empty list for nodes without any. A fan-out of 0 takes all."""
    out, now = None, neighbors
    for layer, fanout in enumerate(fanouts):
        others = F.filter("neighbors", lambda v: v != F.col("qid"))
        keyed = F.array_sort(F.transform(others, lambda v: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed + layer)), "qid", v)).alias("h"), v.alias("v"))))
        chosen = F.transform(F.slice(keyed, 1, fanout) if fanout > 0 else keyed, lambda x: x["v"])
        now = now.select("qid", F.array_sort(F.array_distinct(F.concat(F.array("qid"), chosen))).alias("neighbors"))
        one = now.select("qid", F.lit(layer).alias("layer"), "neighbors")
        out = one if out is None else out.union(one)
    return out


def padded(lists: DataFrame, width: int, col: str = "neighbors") -> DataFrame:
    """Lists filled up with nulls to a width, and a mask of what isn't filling."""
    gap = F.greatest(F.lit(width) - F.size(col), F.lit(0))
    return lists.withColumn("mask", F.concat(F.transform(col, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap))).withColumn(col, F.concat(F.col(col), F.array_repeat(F.lit(None).cast("string"), gap)))


def noise_intervals(weights: DataFrame, unit: int = 1_000_000) -> DataFrame:
    """(qid, low, high, total): whole shares of weights (qid, w) side by side. Sums go by hash bins first."""
    w = weights.select("qid", F.greatest(F.floor(F.col("w") * unit), F.lit(1)).cast("long").alias("w"), F.substring("qid", 1, 3).alias("bin"))
    sizes = w.groupBy("bin").agg(F.sum("w").alias("n"))
    before = sizes.select("bin", (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inner = w.withColumn("high", F.sum("w").over(Window.partitionBy("bin").orderBy("qid")))
    return inner.join(F.broadcast(before), "bin").select("qid", (F.col("before") + F.col("high") - F.col("w")).alias("low"), (F.col("before") + F.col("high")).alias("high"), "total")


def negative_nodes(pairs: DataFrame, intervals: DataFrame, k: int, tries: int = 8, seed: int = 0) -> DataFrame:
    """(center, context, place, qid): for each pair and place below k the first of `tries` draws by share that is neither of the pair. Draws meet
    the nodes' shares by buckets of the range, so neither side is broadcast."""
    size = 1 << 16
    spread = lambda c: F.floor(c / size)
    total = intervals.agg(F.max("total").alias("total"))
    asked = pairs.select("center", "context", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("place")).select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))
    asked = asked.crossJoin(F.broadcast(total))  # one row
    asked = asked.withColumn("at", draw(F.lit(seed), "center", "context", "place", "attempt", below=F.col("total"))).withColumn("bucket", spread(F.col("at")))
    held = intervals.select("qid", "low", "high", F.explode(F.sequence(spread(F.col("low")), spread(F.col("high") - 1))).alias("bucket"))
    got = asked.join(held, "bucket").where("at >= low and at < high and qid <> center and qid <> context")
    return got.groupBy("center", "context", "place").agg(F.min_by("qid", "attempt").alias("qid"))


def kept_edges(edges: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """Edges that stay when each goes with odds percent/100; one at least does, that of the greatest draw."""
    at = draw(F.lit(seed), "parent_qid", "child_qid", below=100)
    out = edges.withColumn("__at", at)
    best = out.agg(F.max(F.struct("__at", "parent_qid", "child_qid")).alias("b"))
    return out.crossJoin(F.broadcast(best)).where((F.col("__at") >= percent) | (F.struct("__at", "parent_qid", "child_qid") == F.col("b"))).select(edges.columns)


def dropped_features(rows: DataFrame, vec: str, percent: int, seed: int = 0, cells: bool = False) -> DataFrame:
    """Vectors with whole columns set to 0, each with odds percent/100; or single cells, by the rows' qid."""
    key = (lambda i: (F.lit(seed), F.col("qid"), i)) if cells else (lambda i: (F.lit(seed), i))
    return rows.withColumn(vec, F.transform(vec, lambda x, i: F.when(draw(*key(i), below=100) < percent, F.lit(0.0)).otherwise(x)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean over a list of vectors (tokens) of those that the mask counts; a mask of nothing divides by one."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))
    first = F.transform(F.get(vectors, 0), lambda x: F.lit(0.0))
    total = F.aggregate(F.arrays_zip(vectors.alias("v"), mask.alias("m")), first, lambda a, r: F.zip_with(a, r["v"], lambda x, y: x + y * r["m"]))
    return F.transform(total, lambda x: x / n)


def mono(channels: Column) -> Column:
    """The mean of a signal's channels, place by place."""
    n = F.size(channels)
    zero = F.transform(F.get(channels, 0), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(channels, zero, lambda a, c: F.zip_with(a, c, lambda x, y: x + y)), lambda x: x / n)

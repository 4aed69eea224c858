import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import classify, clustering, embedding, entity, graph, recordings, resume, runs, signals, similarity, surfaces


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def nodes_of(spark, parents, rank="", pos=True):
    return spark.createDataFrame([(q, p, q.lower(), "", rank, i) for i, (q, p) in enumerate(parents.items())], "qid string, parent_taxon string, en_name string, taxon_name string, taxon_rank_name string, pos int")


def test_graph_adds_placeholders_and_follows_attributes(spark):
    nodes, edges = graph.build_graph(nodes_of(spark, {"A": "", "B": "A", "C": "B", "X": "GONE"}))
    assert rows(nodes, "qid") == [("A",), ("B",), ("C",), ("GONE",), ("X",)]
    assert ("GONE", "X") in rows(edges, "parent_qid", "child_qid")
    up = graph.closure(nodes)
    assert rows(up, "qid", "ancestor", "distance") == [("B", "A", 1), ("C", "A", 2), ("C", "B", 1), ("X", "GONE", 1)]
    assert dict(rows(graph.paths(nodes, up, "A"), "qid", "path"))["C"] == "/A/B/C"


def test_cycles_end(spark):
    nodes = graph.build_nodes(nodes_of(spark, {"B": "C", "C": "B"}))
    edges = graph.build_edges(nodes)
    up = graph.closure(nodes)
    assert rows(up, "qid", "ancestor") == [("B", "C"), ("C", "B")]
    assert dict(rows(graph.paths(nodes, up, "A"), "qid", "path"))["C"] == "/B/C"
    assert rows(graph.descendants(nodes, edges, "B"), "qid", "depth") == [("B", 0), ("C", 1)]


def test_descendants_repeat_by_path_and_stop_at_depth(spark):
    nodes = spark.createDataFrame([(q, q, "", "") for q in "RABD"], "qid string, label_en string, taxon_rank_name string, parent_taxon string")
    edges = spark.createDataFrame([("R", "A"), ("R", "B"), ("A", "D"), ("B", "D")], "parent_qid string, child_qid string")
    assert rows(graph.descendants(nodes, edges, "R"), "qid", "depth") == [("A", 1), ("B", 1), ("D", 2), ("D", 2), ("R", 0)]
    assert rows(graph.descendants(nodes, edges, "R", max_depth=0), "qid") == [("R",)]
    assert rows(graph.bounded_bfs(nodes, edges, "R", 5, 3), "qid", "depth") == [("A", 1), ("B", 1), ("R", 0)]
    assert rows(graph.bounded_bfs(nodes, edges, "R", 5, 9), "qid") == [("A",), ("B",), ("D",), ("R",)]


def test_nearest_ancestor_of_a_rank(spark):
    n = spark.createDataFrame([("F", "", "Family_", "Fam"), ("G", "F", "genus", "Gen"), ("S", "G", "species", "Sp")], "qid string, parent_taxon string, taxon_rank_name string, label_en string")
    n = n.withColumn("taxon_rank_name", F.when(F.col("qid") == "F", "family").otherwise(F.col("taxon_rank_name")))
    got = graph.nearest_of_rank(n, graph.closure(n), "family")
    assert rows(got, "qid", "label_qid", "label_name", "distance_to_label") == [("G", "F", "Fam", 1), ("S", "F", "Fam", 2)]


def test_rank_names_fall_back(spark):
    n = spark.createDataFrame([("1", "", "Q7432"), ("2", "clade", "Q1"), ("3", "", "")], "qid string, taxon_rank_name string, taxon_rank string")
    assert rows(graph.rank_counts(n, item_col="taxon_rank"), "taxon_rank_name", "name_source", "node_count") == [("clade", "graph", 1), ("species", "fallback_wikidata", 1), ("unknown", "unknown", 1)]


ENTITY = {
    "id": "Q1", "type": "item", "labels": {"en": {"language": "en", "value": "Bird"}, "ja": {"value": "鳥"}}, "aliases": {"en": [{"value": "Birdo"}, {"value": ""}]},
    "claims": {"P225": [{"mainsnak": {"datavalue": {"value": "Aves"}}}], "P171": [{"mainsnak": {"datavalue": {"value": {"id": "Q2"}}}}], "P18": [{"mainsnak": {"datavalue": {"value": "a.jpg"}}}]},
    "sitelinks": {"enwiki": {"title": "A bird (x)"}},
}
REST = {"entities": {"Q2": {"id": "Q2", "type": "item", "labels": {"en": "Parent"}, "statements": {"P2426": [{"value": {"type": "novalue"}}, {"value": {"type": "value", "content": "Sp-1"}}]}}}}


def test_entities_of_both_dialects(spark):
    lines = spark.createDataFrame([("[",), (json.dumps(ENTITY) + ",",), (json.dumps(REST),), ("]",), ("",)], "value string")
    got = {r.qid: r for r in entity.ontology(entity.parse(lines)).collect()}
    assert set(got) == {"Q1", "Q2"}
    a, b = got["Q1"], got["Q2"]
    assert (a.en_name, a.ja_name, a.en_aliases, a.img_names, a.taxon_name, a.parent_taxon, a.parent_taxon_name) == ("Bird", "鳥", '["Birdo"]', '["a.jpg"]', "Aves", "Q2", "Parent")
    assert a.enwiki_url == "https://en.wikipedia.org/wiki/A_bird_(x)"
    assert (b.en_name, b.xeno_canto_species_id, b.en_aliases, b.parent_taxon, b.enwiki_url) == ("Parent", "Sp-1", "[]", "", "")


def test_extract_leaves_what_is_done(spark):
    dump = spark.createDataFrame([("Q1",), ("Q2",), ("Q9",)], "qid string")
    want = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "qid string")
    got, missing = entity.extract(dump, want, spark.createDataFrame([("Q2",)], "qid string"))
    assert rows(got, "qid") == [("Q1",)] and rows(missing, "qid") == [("Q3",)]


def test_species_ids(spark):
    df = spark.createDataFrame([("Q1", "", "XC1"), ("", "Q2", "XC2"), ("Q3", "", ""), ("", "", "XC4")], "qid string, id string, xeno_canto_species_id string")
    assert rows(entity.species_ids(df), "qid", "xeno_canto_species_id") == [("Q1", "XC1"), ("Q2", "XC2")]


def test_surfaces_are_numbered_by_text(spark):
    df = spark.createDataFrame([("Q1", "Bird One", '["Bird One","Birdo"]', "Bird One wiki"), ("Q2", "", "[]", "")], "qid string, en_name string, en_aliases string, enwiki_title string")
    m = surfaces.ordinals(surfaces.candidates(df, "en_name", "en_aliases", "enwiki_title", ("en_name", "en_aliases", "enwiki_title"), "en"))
    assert rows(m, "surface_id", "surface_text", "source", "source_index") == [
        ("Q1_en_0", "Bird One", "en_aliases", 1), ("Q1_en_1", "Bird One", "en_name", 0), ("Q1_en_2", "Bird One wiki", "enwiki_title", 3), ("Q1_en_3", "Birdo", "en_aliases", 2),
    ]
    assert rows(surfaces.source_counts(m), "source", "n") == [("en_aliases", 2), ("en_name", 1), ("enwiki_title", 1)]


def test_recordings(spark):
    p = spark.createDataFrame([("Q1", 1, "111", "u1"), ("Q1", 2, "112", ""), ("Q1", 3, "111", "u3"), ("Q1", 4, " ", "")], "qid string, pos int, recording_id string, download_url string")
    m = recordings.recording_map(p)
    assert rows(m, "qid", "recording_count", "recording_ids", "download_urls") == [("Q1", 2, ["111", "112"], ["u1", "https://xeno-canto.org/112/download"])]
    files = recordings.files(spark.createDataFrame([("Q1/111.mp3",), ("x.mp3",), ("Q1/9.tmp",)], "relative_path string"))
    assert rows(recordings.backfilled(files, recordings.index(m)), "recording_id", "download_url") == [("111", "u1")]
    assert rows(recordings.to_fetch(m, files, 5), "recording_id") == [("112",)]


def test_audits_and_folds(spark):
    ex = spark.createDataFrame([("Q1", x) for x in "abc"], "qid string, r string")
    rep = spark.createDataFrame([("Q1", "a", "valid"), ("Q1", "b", "repaired"), ("Q1", "c", "repair_failed")], "qid string, r string, status string")
    keep, gone = recordings.split_by_audit(ex, rep, ["qid", "r"])
    assert rows(keep, "r") == [("a",), ("b",)] and rows(gone, "r") == [("c",)]
    assert tuple(recordings.audit_counts(rep).first()) == (1, 2, 1, 1)
    f = recordings.fold_assignment(spark.createDataFrame([("Q1", "a"), ("Q1", "b"), ("Q2", "c")], "qid string, r string"), "qid", "r", k=5)
    got = {r.r: r for r in f.collect()}
    assert {got["a"].fold_index, got["b"].fold_index} == {0, 1} and got["c"].fold_index is None and got["c"].train_only
    s = recordings.fold_splits(f, 2).where("split = 'test'")
    assert len(rows(s, "fold", "r")) == 2 and "c" not in {r.r for r in s.collect()}


def test_entity_split_counts_round_to_even(spark):
    got = recordings.entity_split(spark.createDataFrame([(f"Q{i}",) for i in range(10)], "qid string"), "qid", 0.25, 0.25)
    n = {r.split: r.n for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"test": 2, "validation": 2, "train": 6}


def test_windows(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)], 2), ([], 2)], "wave array<float>, rate int")
    got = signals.cut_samples(df, "wave", "rate", 3.0, 1.0).orderBy("start").collect()
    assert [(r.start, r.end, r.pad) for r in got] == [(0, 6, 0), (4, 10, 0)]
    got = signals.cut_samples(df, "wave", "rate", 4.0).orderBy("start").collect()
    assert [list(r.samples) for r in got][1] == [8.0, 9.0] + [0.0] * 6


def test_encoders_fail_row_by_row(spark):
    def encoder(batch):
        if any(t == "bad" for (t,) in batch):
            raise ValueError("no")
        return [[len(t), len(t) + 1] for (t,) in batch]

    df = spark.createDataFrame([("ab",), ("bad",), ("abcd",)], "text string").coalesce(1)
    good, bad = resume.split_outcomes(signals.encoded(df, encoder, ["text"]))
    assert rows(good, "text", "embedding") == [("ab", [2.0, 3.0]), ("abcd", [4.0, 5.0])] and rows(bad, "error") == [("ValueError: no",)]


def test_resampling(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], 4)], "wave array<float>, rate int")
    assert signals.resampled(df, "wave", "rate", 8).first().samples == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0]


def test_retrieval_golden(spark):
    # relevance by rank 1, 0, 1
    found = spark.createDataFrame([(0, "a", 1, 1), (0, "a", 2, 0), (0, "a", 3, 1)], "q long, qid string, rank int, rel int")
    r = similarity.query_metrics(found).first()
    assert (round(r.average_precision, 6), r.reciprocal_rank, round(r.ndcg_10, 6)) == (0.833333, 1.0, 0.919721)
    none = similarity.summary(similarity.query_metrics(found.where("rel = 0")), 3, 1).first()
    assert none.evaluated_query_count == 0 and none["map"] == 0.0


def test_matrix_in_blocks_takes_half_the_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 60)
    n, x = 600, np.random.default_rng(3).normal(size=(600, 8)).astype(np.float32).astype(float)
    x[7] = 0
    v = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "idx long, embedding array<double>").coalesce(1)
    similarity.matrix(v).coalesce(1).write.parquet(out := str(tmp_path / "m"))
    got = spark.read.parquet(out).toPandas().sort_values(["q", "c"])
    assert got[["q", "c"]].to_numpy().tolist() == [[i, j] for i in range(n) for j in range(n)]
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = np.round(u @ u.T, 9)
    np.fill_diagonal(want, 1.0)
    assert np.abs(got["sim"].to_numpy() - want.ravel()).max() < 2e-9
    assert sum(f.stat().st_size for f in (tmp_path / "m").glob("*.parquet")) < 6.5 * n * n
    assert similarity.matrix(v.where("idx < 0")).count() == 0


@pytest.mark.parametrize("self_hit, not_same", [(False, None), (True, None), (False, "path")])
def test_metrics_equal_those_of_ranked_pairs(spark, self_hit, not_same):
    # many equal vectors, unknown ids, vectors of no length
    row = lambda i: (i, None if i % 11 == 0 else f"Q{i % 3}", None if i % 7 == 0 else str(i // 4), [float(i * i % 5 - 2), float(i % 3 - 1)])
    v = spark.createDataFrame([row(i) for i in range(90)], "idx long, qid string, path string, embedding array<double>")
    some = v.where("idx % 2 = 0")
    columns = [F.round(c, 9) if c[0] in "arn" else F.col(c) for c in ("q", "qid", "relevant_count", "average_precision", "reciprocal_rank", "ndcg_10", "ndcg_50", "ndcg_100")]
    got = similarity.metrics(some, v, self_hit, not_same)
    assert "Window" not in got._jdf.queryExecution().toString()
    want = sorted(map(tuple, similarity.query_metrics(similarity.ranked(some, v, self_hit, not_same)).select(columns).collect()))
    assert len(want) > 30 and sorted(map(tuple, got.select(columns).collect())) == want
    assert sorted(map(tuple, similarity.metrics(some, v, self_hit, not_same, held=1).select(columns).collect())) == want


def test_metrics_send_short_vectors(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(200, 16)).astype(np.float32)
    v = spark.createDataFrame([(i, f"Q{i % 3}", e) for i, e in enumerate(x.tolist())], "idx long, qid string, embedding array<double>")
    want = rows(similarity.query_metrics(similarity.ranked(v, v, True)), "q", F.round("average_precision", 9))
    sent, send = [], spark.sparkContext.broadcast

    def broadcast(self, value):
        sent.append(max(a.nbytes for a in value if isinstance(a, np.ndarray)))
        return send(value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    got = similarity.metrics(v, v, True)
    assert rows(got, "q", F.round("average_precision", 9)) == want and len(want) == 200 and sent == [200 * 16 * 4]


@pytest.mark.parametrize("cells, want", [([(0, 0, 2), (1, 1, 2)], (1, 1, 1, 1, 1, 1)), ([(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)], (0, 0, 0, 0, 0.5, -0.5)), ([(0, 0, 4)], (1, 1, 1, 1, 1, 1)), ([(0, 0, 2), (1, 0, 2)], (0, 0, 1, 0, 0.5, 0))])
def test_cluster_scores(spark, cells, want):
    assert tuple(round(x, 6) for x in clustering.scores(spark.createDataFrame(cells, "t int, p int, n long")).first()) == want


def test_silhouette_of_singletons(spark):
    df = spark.createDataFrame([(0, "a", [0.0]), (1, "a", [1.0]), (2, "b", [10.0])], "idx long, k string, embedding array<double>")
    s = clustering.silhouette(df, "k").first()
    assert s.sample_count == 3 and s.silhouette == pytest.approx(((10 - 1) / 10 + (9 - 1) / 9 + 1) / 3)
    assert clustering.silhouette(df.where("k = 'a'"), "k").first().silhouette == 0.0


def test_expansion(spark):
    v = lambda *x: spark.createDataFrame([("Q1", i, list(map(float, e))) for i, e in enumerate(x)], "qid string, idx long, embedding array<double>")
    got = classify.expand(spark.createDataFrame([("Q1", "QF"), ("Q9", "QF")], "qid string, label_qid string"), {"graph": v([10, 11]), "audio": v([1], [2], [3]), "language": v([100], [200])})
    assert rows(got, "sample_id", "features")[1] == ("Q1__000001", [10.0, 11.0, 1.0, 200.0]) and got.count() == 6
    assert classify.slices({"graph": 2, "audio": 1, "language": 1}) == {"graph": (0, 2), "audio": (2, 3), "language": (3, 4)}
    with pytest.raises(ValueError):
        classify.slices({})


def test_report(spark):
    p = spark.createDataFrame([("A", "A"), ("B", "B"), ("B", "A")], "true_label string, predicted_label string")
    o = classify.overall(classify.class_report(p)).first()
    assert (o.row_count, round(o.accuracy, 6), round(o.macro_f1, 6)) == (3, 0.666667, 0.666667)


def test_softmax_learns_a_toy(spark):
    df = spark.createDataFrame([([-2.0, -1.0], "left"), ([-1.5, -1.2], "left"), ([1.0, 1.0], "right"), ([1.5, 1.2], "right")], "features array<double>, label_qid string")
    model, trace = classify.softmax_regression(df, epochs=25)
    losses = [r.train_loss for r in trace.orderBy("epoch").collect()]
    assert losses[-1] < losses[0] and all(r.predicted_label == r.label_qid for r in classify.predict(df, model).collect())


def test_walks_follow_edges_and_repeat(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent_qid string, child_qid string")
    n = graph.neighbor_map(edges)
    ok = {frozenset(x) for x in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]}
    got = embedding.walks(n, length=6, per_node=2, q=0.5)
    assert got.count() == 8 and all(len(r.walk) == 6 and all(frozenset(x) in ok for x in zip(r.walk, r.walk[1:], strict=False)) for r in got.collect())
    assert rows(got, "qid", "walk_no", "walk") == rows(embedding.walks(n, length=6, per_node=2, q=0.5), "qid", "walk_no", "walk")


def test_walks_have_the_odds_asked_for(spark):
    # from c, after a: back to a by 1/p, to b (a neighbour of a) by 1, to d and e by 1/q
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "e")], "parent_qid string, child_qid string")
    for p, q in ((0.5, 2.0), (4.0, 0.25), (1.0, 1.0)):
        got = embedding.walks(graph.neighbor_map(edges), length=3, per_node=8000, p=p, q=q, seed=3).where("walk[0] = 'a' and walk[1] = 'c'").groupBy(F.col("walk")[2].alias("v")).count()
        n = {r.v: r["count"] for r in got.collect()}
        odds = {"a": 1 / p, "b": 1.0, "d": 1 / q, "e": 1 / q}
        assert n.keys() == odds.keys() and sum(n.values()) > 3500
        assert all(abs(n[v] / sum(n.values()) - x / sum(odds.values())) < 0.03 for v, x in odds.items())


def test_walks_around_a_hub_take_no_square_of_its_size(spark):
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(6000)], "parent_qid string, child_qid string")
    began = time.monotonic()
    assert embedding.walks(graph.neighbor_map(edges), length=4, p=0.5, q=2.0).where("size(walk) = 4").count() == 2 * 6001
    assert time.monotonic() - began < 60


def test_each_edge_has_a_negative(spark):
    real = {("hub", f"n{i}") for i in range(100)} | {(f"n{i}", f"n{i + 100}") for i in range(100)}
    edges = spark.createDataFrame(sorted(real), "parent_qid string, child_qid string")
    nodes = spark.createDataFrame([(q,) for q in sorted({q for e in real for q in e})], "qid string")
    got = embedding.negative_edges(edges, nodes).collect()
    assert sorted((r.parent_qid, r.child_qid) for r in got) == sorted(real)
    assert all((r.neg_parent, r.neg_child) not in real and (r.neg_parent == r.parent_qid or r.neg_child == r.child_qid) for r in got)
    full = spark.createDataFrame([(a, b) for a in "xy" for b in "xy"], "parent_qid string, child_qid string")
    with pytest.raises(ValueError):
        embedding.negative_edges(full, spark.createDataFrame([("x",), ("y",)], "qid string"), tries=2)


def test_transe_and_node2vec_give_vectors(spark):
    edges = spark.createDataFrame([("Q1", "Q2"), ("Q2", "Q3")], "parent_qid string, child_qid string")
    v, trace = embedding.transe(edges, size=4, epochs=3)
    assert v.count() == 3 and [r.epoch for r in trace.orderBy("epoch").collect()] == [1, 2, 3] and all(r.average_loss >= 0 for r in trace.collect())
    with pytest.raises(ValueError):
        embedding.transe(edges, limit=1)
    assert embedding.node2vec(embedding.walks(graph.neighbor_map(edges), 4), size=3).count() == 3


def plain_transe(h, t, n, size, epochs, rate=0.01, margin=1.0, seed=0):
    """TransE's full-batch steps by whole tables of differences."""
    rng, m = np.random.default_rng(seed), len(h)
    bound = 6 / size**0.5
    e = np.stack([rng.uniform(-bound, bound, n).astype(np.float32) for _ in range(size)], 1)
    r, out = rng.uniform(-bound, bound, size), []
    e /= np.sqrt((e * e).sum(1, keepdims=True))
    r /= np.linalg.norm(r)
    for epoch in range(1, epochs + 1):
        bad, head = rng.integers(0, n, m), rng.random(m) < 0.5
        nh, nt = np.where(head, bad, h), np.where(head, t, bad)
        pos, neg = e[h] + r - e[t], e[nh] + r - e[nt]
        loss = margin + np.abs(pos).sum(1) - np.abs(neg).sum(1)
        hit = (loss > 0)[:, None]
        gp, gn, g = np.sign(pos) * hit, np.sign(neg) * hit, np.zeros((n, size))
        for at, x in ((h, gp), (t, -gp), (nh, -gn), (nt, gn)):
            np.add.at(g, at, x)
        e, r = (e - rate * g).astype(np.float32), r - rate * (gp - gn).sum(0) / m
        e /= np.sqrt((e * e).sum(1, keepdims=True))
        out.append((epoch, float(np.maximum(loss, 0).mean()), int(hit.sum())))
    return e, out


@pytest.mark.parametrize("threads", [1, 2])
def test_transe_steps_are_those_of_whole_tables(monkeypatch, threads):
    monkeypatch.setattr(embedding, "AT_ONCE", 32)
    monkeypatch.setattr(embedding, "THREADS", threads)
    rng = np.random.default_rng(3)
    added, add_rows = [], embedding._add_rows
    monkeypatch.setattr(embedding, "_add_rows", lambda to, at, *more: (added.append(len(at)), add_rows(to, at, *more)))
    # hubs on either side, edges that repeat, loops
    h, t = np.concatenate([rng.integers(0, 60, 400), np.zeros(300, int), rng.integers(0, 60, 300)]), np.concatenate([rng.integers(0, 60, 700), np.ones(300, int)])
    e, out = embedding.transe_steps(h, t, 60, 16, 8, 0.01, 1.0, 0)
    want, trace = plain_transe(h, t, 60, 16, 8)
    assert np.allclose(e, want, atol=1e-4)
    assert [x[::2] for x in out] == [x[::2] for x in trace] and np.allclose([x[1] for x in out], [x[1] for x in trace], atol=1e-5)
    # only edges within the margin cost sums, one for each end
    assert sum(added) == 3 * sum(x[2] for x in out) < 3 * 8 * len(h)


def test_runs(spark):
    ids = spark.createDataFrame([(0, "s0"), (1, "s1")], "row_idx int, surface_id string")
    man = spark.createDataFrame([("s0", "ja", 0), ("s0", "en", 1)], "surface_id string, language string, row_no int")
    assert rows(runs.language_run(ids, man, "xx"), "surface_id", "language") == [("s0", "en"), ("s1", "xx")]
    assert runs.specs({"G": ["g1"], "L": ["l2", "l1"], "A": []}, ["lg", "A", "G"]) == [("GL", ("g1", "l1")), ("GL", ("g1", "l2")), ("G", ("g1",))]
    m = spark.createDataFrame([("r1", "Q1", "Q1/b"), ("r1", "Q1", "Q1/a"), ("r2", "Q1", "Q1/b")], "run string, qid string, relative_path string")
    assert rows(runs.representative_files(m, 2), "qid", "relative_path") == [("Q1", "Q1/b")]

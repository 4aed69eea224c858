import json
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import runs as runs_of
from strataspark.sources import sinks, stores


def put(folder, vectors, qids, **more):
    folder.mkdir(parents=True)
    np.save(folder / "embeddings.npy", np.array(vectors, np.float32))
    (folder / "qids.json").write_text(json.dumps(qids))
    for name, content in {"metadata.json": {}, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "graph/gcn/0101", [[1, 0], [0, 1], [2, 2], [9, 9]], {"qids": [" Q1 ", "Q2", "Q1", ""]})
    put(tmp_path / "graph/gcn/0202", [[5, 5]], ["Q1"])
    (tmp_path / "graph/gcn/0303").mkdir()  # holds no run
    manifest = "surface_id\tqid\tordinal\tlanguage\tsurface_text\tsource\ns0\tQ2\tx\tja\tb\tname\ns1\tQ1\t5\t\ta\talias\ns2\tQ1\t1\t\tc\tname\n"
    put(tmp_path / "language/en", [[1, 1], [2, 2], [3, 3]], ["Q2", "Q1", "Q1"], surface_ids__json=["s0", "s1", "s2"], surface_manifest__tsv=manifest, metadata__json={"language": "de"})
    audio = "audio_id\tqid\trelative_path\twindow_index\na0\tQ1\tQ1/x.mp3\t\n\tQ1\tQ1/x.mp3\t1\na2\t\tQ2/y.mp3\t0\na3\tQ1\tQ1/a.mp3\t0\n"
    put(tmp_path / "audio/perch/v1/0101", [[2, 0], [4, 2], [1, 1], [7, 7]], ["Q1", "Q1", "Q2", "Q1"], audio_ids__json=["a0", "a1", "a2", "a3"], audio_manifest__tsv=audio)
    return tmp_path


def test_discovery_and_registry(spark, root):
    found = stores.discover_all(spark, str(root))
    assert [r.name for r in found] == ["graph__gcn__0101", "graph__gcn__0202", "language__en", "audio__perch__v1__0101"]
    assert stores.latest_dir(spark, f"{root}/graph/gcn", ("qids.json",)).endswith("gcn/0202")
    assert stores.latest_dir(spark, f"{root}/graph/gcn").endswith("gcn/0303")
    with pytest.raises(FileNotFoundError):
        stores.latest_dir(spark, f"{root}/none")
    (root / "runs.json").write_text(json.dumps({"runs": {"graph": {"g": "graph/gcn/0101"}, "audio": {"p": str(root / "audio/perch/v1/0101")}}}))
    got = stores.registry(spark, f"{root}/runs.json", str(root))
    assert [(r.modality, r.label) for r in got] == [("graph", "g"), ("audio", "p")] and got[0].path == f"{root}/graph/gcn/0101"
    for bad in ([], {"runs": []}, {"runs": {"graph": []}}):
        (root / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            stores.registry(spark, f"{root}/bad.json", str(root))


def test_runs(spark, root):
    g = stores.graph_run(spark, f"{root}/graph/gcn/0101").orderBy("row_idx").collect()
    assert [(r.qid, list(r.embedding)) for r in g] == [("Q1", [1, 0]), ("Q2", [0, 1]), ("Q1", [2, 2]), ("", [9, 9])]
    a = stores.audio_rows(spark, f"{root}/audio/perch/v1/0101").orderBy("row_idx").collect()
    assert [(r.audio_id, r.qid, r.window_index) for r in a] == [("a0", "Q1", 0), ("a1", "Q1", 1), ("a2", "Q2", 0), ("a3", "Q1", 0)]
    s = stores.language_rows(spark, f"{root}/language/en").orderBy("row_idx").collect()
    assert [(r.surface_id, r.qid, r.language, r.surface_text) for r in s] == [("s0", "Q2", "ja", "b"), ("s1", "Q1", "de", "a"), ("s2", "Q1", "de", "c")]
    (root / "graph/gcn/0202/qids.json").write_text('["Q1", "Q2"]')
    with pytest.raises(ValueError):
        stores.graph_run(spark, f"{root}/graph/gcn/0202")
    (root / "graph/gcn/0202/qids.json").write_text('"x"')
    with pytest.raises(ValueError):
        stores.id_list(spark, f"{root}/graph/gcn/0202/qids.json")


def test_bundles(spark, root):
    runs = [r for r in stores.discover_all(spark, str(root)) if r.label != "gcn__0202"]
    t = stores.bundles(spark, runs)
    rows = [(r.modality, r.qid, r.source_id, r.pos, list(r.embedding)) for r in t.orderBy("modality", "qid", "pos").collect()]
    assert rows == [
        ("A", "Q1", "Q1/a.mp3", 0, [7, 7]), ("A", "Q1", "Q1/x.mp3", 1, [3, 1]), ("A", "Q2", "Q2/y.mp3", 0, [1, 1]),
        ("G", "Q1", "Q1", 0, [1, 0]), ("G", "Q1", "Q1", 1, [2, 2]), ("G", "Q2", "Q2", 0, [0, 1]),
        ("L", "Q1", "s2", 0, [3, 3]), ("L", "Q1", "s1", 1, [2, 2]), ("L", "Q2", "s0", 0, [1, 1]),
    ]
    chosen = spark.createDataFrame([("Q1", "Q1/x.mp3"), ("Q2", "Q2/y.mp3")], "qid string, relative_path string")
    maps = {(r.modality, r.qid): list(r.embedding) for r in stores.vector_maps(t, chosen).collect()}
    assert maps[("A", "Q1")] == [3, 1] and maps[("G", "Q1")] == [1, 0] and maps[("L", "Q1")] == [3, 3] and len(maps) == 6
    assert {(r.modality, r.qid_count, r.row_count, r.dim) for r in stores.inspected(t).collect()} == {("A", 2, 3, 2), ("G", 2, 3, 2), ("L", 2, 3, 2)}
    assert stores.bundles(spark, runs, {"graph": set(), "audio": {"perch__v1__0101"}}).select("modality").distinct().count() == 2
    assert runs_of.complete_ids(t.withColumn("run", F.concat("modality", "label")), 3).count() == 2
    with pytest.raises(ValueError):
        stores.bundles(spark, [])


def test_replacing_appending_and_upserts(spark, tmp_path):
    p = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    sinks.replaced(one, p)
    sinks.replaced(spark.read.parquet(p).where("k = 1"), p)  # reads what it replaces
    assert spark.read.parquet(p).count() == 1
    sinks.append_missing(spark.createDataFrame([(1, "z"), (3, "c"), (3, "c")], "k long, v string"), p, ["k"])
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [(1, "a"), (3, "c")]
    sinks.upsert(spark.createDataFrame([(3, "d", 1), (3, "e", 2), (4, "f", 1)], "k long, v string, at int").select("k", "v", "at").drop("at"), p, ["k"], F.col("v"))
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [(1, "a"), (3, "e"), (4, "f")]
    assert [x.name for x in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception):  # noqa: B017
        sinks.replaced(one.select(F.raise_error(F.lit("stop")).alias("x")), p)
    assert spark.read.parquet(p).count() == 3
    e = spark.createDataFrame([("Q12", "x"), ("Q3", "y")], "qid string, value string")
    sinks.shard_entities(e, str(tmp_path / "shards"))
    got = sinks.shard_entities(e.union(spark.createDataFrame([("Q12", "new"), ("Q55", "z")], e.schema)), str(tmp_path / "shards"))
    assert {(r.qid, r.value) for r in got.collect()} == {("Q12", "x"), ("Q3", "y"), ("Q55", "z")} and (tmp_path / "shards/d1=1/d2=2").exists()


def test_graph_store_and_cascade(spark, tmp_path):
    nodes = spark.createDataFrame([("R",), ("A",), ("B",)], "qid string")
    edges = spark.createDataFrame([("R", "A"), ("A", "B")], "parent_qid string, child_qid string")
    sinks.write_graph(nodes, edges, spark.createDataFrame([("k", "v")], "key string, value string"), str(tmp_path / "g"))
    n, e = sinks.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 3 and e.count() == 2
    sinks.delete_cascade(str(tmp_path / "g/nodes"), str(tmp_path / "g/edges"), spark.createDataFrame([("B",)], "qid string"))
    n, e = sinks.read_graph(spark, str(tmp_path / "g"))
    assert {r.qid for r in n.collect()} == {"R", "A"} and [tuple(r) for r in e.collect()] == [("R", "A")]
    sinks.write_ontology(nodes.withColumn("x", F.lit(1)), str(tmp_path / "o"))
    assert [r.qid for r in sinks.read_ontology(spark, str(tmp_path / "o")).collect()] == ["A", "B", "R"]
    with pytest.raises(ValueError):
        sinks.read_ontology(spark, str(tmp_path / "g/edges"))
    with pytest.raises(ValueError):
        replaced = str(tmp_path / "h")
        sinks.write_graph(edges, edges, edges, replaced)
        sinks.read_graph(spark, replaced)


def test_reports(spark, tmp_path):
    p = str(tmp_path)
    v = spark.createDataFrame([("Q2", [1.0, 2.0]), ("Q1", [0.0, 1.0])], "qid string, embedding array<double>")
    sinks.write_graph_run(v, spark.createDataFrame([(2, 0.5), (1, 0.7)], "epoch int, average_loss double"), {"algorithm": "gcn"}, f"{p}/run")
    meta = json.loads((tmp_path / "run/metadata.json").read_text())
    assert meta["node_count"] == 2 and meta["dim"] == 2 and meta["algorithm"] == "gcn"
    assert spark.read.option("header", True).csv(f"{p}/run/trace").first().epoch == "1"
    row = {"method": "gcn", **{m: 0.25 for m in sinks.METRICS}, "mean_rank": 1.0}
    ranks = spark.createDataFrame([row | {"method": "x", "mean_rank": 2.0}, row])
    sinks.write_cluster_report(ranks, {"gcn": spark.createDataFrame([("Q1", "a", 0)], "qid string, true_label string, cluster_id int")}, f"{p}/clusters", "family", "g", "e")
    text = (tmp_path / "clusters/report.md").read_text()
    assert text.index("| gcn | 0.2500 |") < text.index("| x | 0.2500 |") and "| 1.00 |" in text and "`family`" in text
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{p}/clusters/gcn_assignments").first().cluster_id == "0"
    pred = spark.createDataFrame([("s", "Q1", "test", "family", "a", "b", "G", "more")], [*sinks.PREDICTIONS, "more"])
    sinks.write_evaluation(pred, spark.createDataFrame([("test", 3, 1 / 3, 0.5)], "split string, row_count long, accuracy double, macro_f1 double"), f"{p}/eval", {"seed": 1})
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{p}/eval/metrics").first().accuracy == "0.333333"
    one = dict.fromkeys(sinks.RETRIEVAL, 0.125)
    runs = spark.createDataFrame([{"run_name": "r", "modalities": "GL", "run_labels": "a,b", "sample_count": 3, "query_count": 3, "evaluated_query_count": 2, **one}])
    sinks.write_retrieval(runs, None, f"{p}/ret", {"x": 1})
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{p}/ret/metrics").first()["nDCG@10"] == "0.1250000000"
    sinks.write_repair_report(spark.createDataFrame([("Q1", "valid")], "qid string, status string"), spark.createDataFrame([(1, 0)], "valid long, invalid long"), f"{p}/rep")
    assert json.loads((tmp_path / "rep/repair_summary.json").read_text()) == {"valid": 1, "invalid": 0}
    sinks.write_wiki(spark.createDataFrame([("Q1", "en")], "qid string, language string"), spark.createDataFrame([("Q1", "words")], "qid string, text string"), f"{p}/wiki")
    sinks.write_surfaces(spark.createDataFrame([("s0", "en")], "surface_id string, language string"), spark.createDataFrame([("Q1", ["a"])], "qid string, surfaces array<string>"), f"{p}/lang")
    assert (tmp_path / "lang/manifest/language=en").exists()
    sinks.write_similarity(v, v, v, f"{p}/sim")
    for batch in (0, 1, 1):
        sinks.write_audio_batch(v, f"{p}/audio", batch)
    assert spark.read.parquet(f"{p}/audio").count() == 4
    at = datetime(2026, 5, 4, 3, 2, 1, 9, tzinfo=timezone.utc)
    assert [sinks.utc_stamp(k, at) for k in ("iso", "tag", "folder")] == ["2026-05-04T03:02:01+00:00", "05040302", "20260504T030201Z"]

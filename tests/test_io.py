import bz2
import os
import shutil
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from strataspark.sources import files
from strataspark.sources.npy import NpySource
from strataspark.streaming import ingest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"x'), ("", "tab\there"), ("b", None)], "k string, v string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.tsv(spark, str(tmp_path / "t")).collect())) == [("", "tab\there"), ("a", 'q"x'), ("b", "")]


def test_dump_lines_of_bz2(spark, tmp_path):
    (tmp_path / "d.json.bz2").write_bytes(bz2.compress(b'[\n{"id":"Q1"},\n{"id":"Q2"}\n]\n'))
    assert sorted(r.value for r in files.dump_lines(spark, str(tmp_path)).collect()) == ['{"id":"Q1"}', '{"id":"Q2"}']


def test_pages_media_and_wiki(spark, tmp_path):
    (tmp_path / "p/Q1").mkdir(parents=True)
    (tmp_path / "p/Q1/page1.json").write_text('{"recordings":[{"id":"111","file":"u"}]}')
    (tmp_path / "p/Q1/page2.json").write_text('{"recordings":[{"id":"112"}]}')
    assert [(r.qid, r.recording_id) for r in files.page_files(spark, str(tmp_path / "p")).orderBy("pos").collect()] == [("Q1", "111"), ("Q1", "112")]
    (tmp_path / "m/Q1").mkdir(parents=True)
    (tmp_path / "m/Q1/1.MP3").write_bytes(b"abc")
    (tmp_path / "m/Q1/1.txt").write_bytes(b"abc")
    assert [r.length for r in files.media_files(spark, str(tmp_path / "m")).collect()] == [3]
    (tmp_path / "w.xml").write_text('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/"><page><title>T</title><revision><text>old</text></revision><revision><text>new</text></revision></page></mediawiki>')
    assert [tuple(r) for r in files.wiki_pages(spark, str(tmp_path / "w.xml")).collect()] == [("T", "new")]
    (tmp_path / "r.json").write_text('{"runs": {"graph": {"g": "a/b"}, "audio": {}}}')
    assert [tuple(r) for r in files.run_registry(spark, str(tmp_path / "r.json")).collect()] == [("graph", "g", "a/b")]


def test_npy_source(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    spark.dataSource.register(NpySource)
    got = spark.read.format("npy").option("rows", 2).load(str(tmp_path / "m.npy")).orderBy("row_idx").collect()
    assert [list(r.embedding) for r in got] == [[0, 1], [2, 3], [4, 5]]


def test_streams_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    targets = spark.createDataFrame([("a",), ("b",)], "qid string")

    def run():
        s = ingest.source(spark, src, "qid string, n int", 1)
        ingest.append(ingest.extract_stream(s, targets), out, ck).awaitTermination()
        return sorted(r.qid for r in spark.read.parquet(out).collect())

    spark.createDataFrame([("a", 1), ("z", 1)], "qid string, n int").coalesce(1).write.mode("append").parquet(src)
    assert run() == ["a"]
    spark.createDataFrame([("a", 2), ("b", 2)], "qid string, n int").coalesce(1).write.mode("append").parquet(src)
    assert run() == ["a", "b"]


def test_windows_over_events(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    shutil.copy(f"{sf}/events.parquet", tmp_path)
    s = ingest.source(spark, str(tmp_path), e.schema)
    q = ingest.tumbling(s, "ts", "1 hour", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    want = e.groupBy(F.window("ts", "1 hour"), "event_type").count().count()
    assert spark.table("hours").count() == want and spark.table("hours").agg(F.sum("n")).first()[0] == e.count()


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(o) <= set(q) and len(q) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})

import re

import corpus_pipeline
from strataspark.llm import minhash
from strataspark.llm.common import cut, table

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}""")


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(cut(stage(spark, seen[-1], sf), f"t{k}"))
        if k < 4:
            assert seen[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in x.collect()} for x in seen]
    n = [len(r) for r in rows]
    assert n[0] > n[1] > n[2] >= n[3] == n[4] == n[5] > 0

    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in rows[1] for i in good) >= 0.97 * len(good)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in rows[1] for i in bad) <= 0.4 * len(bad)

    # one document of each group stays: the smallest of its near-duplicates
    found = {r.doc_id: r for r in minhash.near_duplicates(seen[1]).collect()}
    assert set(rows[2]) == {i for i, r in found.items() if r.component_id == i}

    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    assert {i for i, r in rows[2].items() if any(t in r.text for t in items)} <= set(rows[2]) - set(rows[3])
    assert not any(ASSIGN.search(r.text) for r in rows[4].values())
    for i, r in rows[4].items():
        assert r.n_chars == len(r.text) and (r.text == rows[3][i].text or "[SECRET]" in r.text)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows[5].values())


def test_odd_rows_pass(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "fine words stand here today", "en", "s", 27), (3, "fine words stand here today", "en", "s", 27)], table(spark, sf, "documents").schema)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "None"]
    for _, stage in corpus_pipeline.STAGES[2:]:
        out = cut(stage(spark, out, sf), "odd")
    assert out.count() == 4
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), sf).count() == 0

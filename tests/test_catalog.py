"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from strataspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    want = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_other_queries_give_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_transe_trains_on_all_edges(spark, sf, monkeypatch):
    seen = {}

    def transe(edges, **given):
        seen.update(given, edges=edges.count())
        return edges, edges

    monkeypatch.setattr(catalog.embedding, "transe", transe)
    catalog.QUERIES["transe_train"](spark, sf)
    assert seen == {"edges": catalog.QUERIES["tax_edges"](spark, sf).count(), "size": 128, "epochs": 200}


def test_sample_expand_all_uses_every_vector(spark, sf):
    by, want = {}, []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        by.setdefault(f"L{r.label}", []).append(sum(map(float, r.embedding)))
    for qid in sorted(by):
        first, rest = by[qid][0], by[qid][1:]
        audio, language = rest[:7:2], rest[1:7:2] + rest[7:]
        assert len(rest) == len(audio) + len(language) > 7
        for x in audio:
            want += [(f"{qid}__{len(want) + k:06d}", qid, first + x + y) for k, y in enumerate(language)]
    got = sorted(catalog.QUERIES["sample_expand_all"](spark, sf).collect(), key=lambda r: int(r.sample_id.split("__")[1]))
    assert [(r.sample_id, r.qid) for r in got] == [w[:2] for w in want]
    assert all(abs(r.total - w[2]) < 1e-4 for r, w in zip(got, want, strict=True))

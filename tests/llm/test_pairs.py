import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import components as components_of
from strataspark.llm import decontam, minhash
from strataspark.llm.components import components


def brute(rows, words, percent):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(a), find(i), find(i) == i) for i, a in sets if i is not None)


def near_copies(n=60, seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, k = [], 0
    for g in range(6):
        base = [word() for _ in range(rnd.choice([8, 20, 60, 150]))]
        for _ in range(n // 6):
            t = base[:]
            for _ in range(rnd.randrange(0, max(2, len(t) // 12))):
                t[rnd.randrange(len(t))] = word()
            rows.append((k * 7 % 1000, " ".join(t)))
            k += 1
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_copies() + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One two"), (2004, "oNE\ttwo"), (2005, "one"), (2006, "É é x"), (2007, "é É x"), (2008, "a b c " * 9000), (2009, "a b c " * 8990)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_shingles int, sig string").repartition(5)
    got = minhash.near_duplicates(df, words=3, percent=85)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(rows, 3, 85)
    got = minhash.near_duplicates(df)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(rows, 5, 80)
    assert len({r[2] for r in brute(rows, 3, 85)}) < len(rows) - 10


def test_near_duplicates_of_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (2, "x y z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (2, 2, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_texts_of_one_id_are_one_document(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b.replace("b30", "z")), (3, a.replace("a30", "z")), (4, "x y"), (4, ""), (5, "x y"), (9, None), (9, "other words")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(rows, 3, 85)
    named = spark.createDataFrame([(f"id{i}", t) for i, t in rows], "name string, body string")
    got = minhash.near_duplicates(named, "name", "body", words=3, percent=85)
    assert sorted(tuple(r) for r in got.select("name", "n_shingles", "component_id", "kept").collect()) == [(f"id{i}", n, f"id{c}", k) for i, n, c, k in brute(rows, 3, 85)]


def test_small_blocks_and_packs_lose_no_link(spark, monkeypatch):
    # families whose members are often just above or below the threshold, over many blocks and packs
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rnd, rows = random.Random(11), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(90)]
        for _ in range(60):
            t = base[:]
            for _ in range(rnd.randrange(0, 6)):
                t[rnd.randrange(len(t))] = f"v{rnd.randrange(12)}"
            rows.append((len(rows), " ".join(t)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=3, percent=85)
    want = brute(rows, 3, 85)
    assert 3 < len({r[2] for r in want}) < 120
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == want


def test_across_links_what_differs_in_label_only(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rnd = random.Random(4)
    rows = [(g, i, rnd.choice([0, 0, 0, 1, 2]), bytes([rnd.randrange(4)])) for g in range(4) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, node long, comp long, data binary")
    test = lambda a, b: np.array([[x.as_py() == y.as_py() for y in b] for x in a])
    got = {(r.a, r.b) for r in minhash._across(df.withColumn("node", F.expr("g * 100 + node")), ["g"], test).collect()}
    by = {g * 100 + i: (g, c, d) for g, i, c, d in rows}
    assert all(by[a][0] == by[b][0] and by[a][1] != by[b][1] and by[a][2] == by[b][2] for a, b in got)
    found = {(by[a][0], *sorted((by[a][1], by[b][1]))) for a, b in got}
    assert found == {(x[0], *sorted((x[1], y[1]))) for x in by.values() for y in by.values() if x[0] == y[0] and x[1] != y[1] and x[2] == y[2]}


def test_intersections_equal_the_plain_ones(monkeypatch):
    monkeypatch.setattr(minhash, "WIDTH", 16)
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 200, rng.integers(1, 90))).astype(np.uint64) for _ in range(n)] for n in (9, 12))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert minhash.intersections(a, b).astype(int).tolist() == want
    links = np.array([[x == y or {x, y} <= {0, 3, 5} or {x, y} == {1, 2} for y in range(6)] for x in range(6)])
    assert sorted(map(tuple, map(sorted, minhash.spanning(links)))) == [(0, 3), (0, 5), (1, 2)]


def test_components_by_rounds_equal_those_at_once(spark, monkeypatch):
    rnd = random.Random(8)
    edges = spark.createDataFrame([(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)], "a long, b long")
    at_once = sorted(map(tuple, components(edges, "a", "b").collect()))
    monkeypatch.setattr(components_of, "SMALL", 0)
    assert sorted(map(tuple, components(edges, "a", "b").collect())) == at_once


def test_one_block_is_not_enough_for_a_large_group(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(500):
        t = base[:]
        for _ in range(rnd.randrange(1, 9)):
            t[rnd.randrange(len(t))] = f"v{rnd.randrange(10**6)}"
        rows.append((k, " ".join(t)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(rows, 3, 85)


def test_shingles_that_another_block_holds_twice_are_not_lone(spark, monkeypatch):
    # one cluster of families in two blocks; of a family (x, y, z) x links to y only, by a hair, and the estimate may prefer z
    monkeypatch.setattr(minhash, "BLOCK", 60)
    base, rows = [f"w{i}" for i in range(200)], []
    for g in range(40):
        x = [f"f{g}_{i}" if i < 30 else w for i, w in enumerate(base)]
        y = [f"y{g}_{i}" if 100 <= i < 114 else w for i, w in enumerate(x)]
        z = [f"z{g}" if i == 114 else w for i, w in enumerate(y)]
        rows += [(3 * g + k, " ".join(t)) for k, t in enumerate((x, y, z))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    want = brute(rows, 3, 85)
    assert len({r[2] for r in want}) == 40
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == want


def test_lone_counts_over_blocks(spark):
    sets = {1: (0, [1, 2, 3, 4]), 2: (1, [2, 3, 5]), 3: (1, [2, 3, 6]), 4: (2, [4, 7])}
    rows = [(9, b, k, np.array(x, np.uint64).tobytes()) for k, (b, x) in sets.items()]
    got = minhash._lone_counts(spark.createDataFrame(rows, "cluster long, block long, node long, set binary")).collect()
    assert {r.node: r.lone for r in got} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_estimate_and_compression():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.85, 1.0):
        n = int(round(2 * share * 2000 / (1 + share)))
        x, y = a[:2000], np.concatenate([a[:n], rng.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)])
        est = minhash.similarity(minhash.compress(minhash.registers(x)), minhash.compress(minhash.registers(y)))
        assert abs(est - share) < 0.16
    assert (minhash.compress(minhash.registers(np.zeros(0, np.uint64))) == minhash.EMPTY).all()


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, 5000), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges[:-1]:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: find(i) for i in root if find(i) != i}


def levenshtein_ends(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[1:]


@pytest.mark.parametrize("size", [1, 7, 64, 90])
def test_myers_equals_the_table(size):
    rnd = random.Random(size)
    for _ in range(60):
        p, t = [rnd.choice("abc") for _ in range(size)], [rnd.choice("abcd") for _ in range(rnd.randrange(1, 120))]
        assert decontam.distances(p, t) == levenshtein_ends(p, t)


def test_leaks_with_and_without_edits(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    items = [(1, " ".join(item)), (2, "Short One."), (3, None), (4, "..."), (1000, " ".join(item[:20]))]
    k = decontam.budget(40)
    edited = item[:3] + ["changed"] + item[4:15] + item[16:30] + ["put", "in"] + item[30:]
    broken = [w if i % 4 else "no" for i, w in enumerate(item)]
    pad = " ".join(word() for _ in range(30))
    docs = [
        (1, f"{pad} {' '.join(item).upper()}! {pad}"), (2, f"{pad} {' '.join(edited)} {pad}"), (3, f"{pad} {' '.join(broken)} {pad}"), (4, None), (5, ""), (6, pad), (7, "a short, one"), (8, f"é 😀 {', '.join(item)}"),
        (1, f"{pad} {' '.join(item).upper()}! {pad}"),
    ]
    d = spark.createDataFrame([(*x, "d") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(d, b).collect()
    assert k >= 4 and sorted({(r.doc_id, r.item_id) for r in got}) == [(1, 1), (1, 1000), (2, 1), (2, 1000), (7, 2), (8, 1), (8, 1000)]
    by = {(r.doc_id, r.item_id): r for r in got}
    assert by[2, 1].distance == 4 and by[1, 1].distance == 0
    t = dict(docs)[8]
    assert t[by[8, 1].match_start : by[8, 1].match_end] == ", ".join(item)
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontam.leaks(d.limit(0), b).collect() == [] and decontam.leaks(d, b.limit(0)).collect() == []
    assert decontam.decontaminate(d, b.limit(0)).count() == len(docs)


def test_every_passage_of_the_table_is_found(spark, sf):
    from strataspark.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + 3


def edited(words, item, k):
    """Least edit distance over words of item to any stretch of words, and whether it is at most k."""
    return min(levenshtein_ends(item, words), default=len(item)) <= k


def test_leaks_of_the_table_equal_brute_force(spark, sf, monkeypatch):
    from strataspark.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    low = lambda t: decontam.WORD.findall((t or "").lower())
    texts = {d.doc_id: low(d.text) for d in docs}
    rnd = random.Random(1)
    # every document that shares three words with an item, and some that don't, by the plain table of distances
    want, checked = set(), set()
    for i in items:
        w = low(i.text)
        grams = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
        for d, t in texts.items():
            if len(t) < 1500 and (rnd.random() < 0.002 or any(tuple(t[j : j + 3]) in grams for j in range(len(t) - 2))):
                checked.add((d, i.item_id))
                if w and edited(t, w, decontam.budget(len(w))):
                    want.add((d, i.item_id))
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, sf).collect()}
    assert want and got & checked == want
    # in several passes the result is the same
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").limit(40)
    some = {r.item_id for r in b.collect()}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()} == {x for x in got if x[1] in some}
    kept = {r.doc_id for r in decontam.decontaminate(d, b).collect()}
    assert kept == set(texts) - {x[0] for x in got if x[1] in some}


def test_item_ids_may_be_text(spark):
    d = spark.createDataFrame([("d1", "one two three four", 1)], "name string, body string, item_id int")
    b = spark.createDataFrame([("x", "two three"), (None, "four")], "item string, words string")
    got = decontam.leaks(d, b, "name", "body", "item", "words").collect()
    assert {(r.name, r.item_id, r.match_start) for r in got} == {("d1", None, 14), ("d1", "x", 4)}

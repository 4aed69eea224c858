import hashlib
import os
import random

import numpy as np

from strataspark.llm import mtree, suffix


# ---- M-tree


def best(rows, queries, k=5):
    out = {}
    for q, v in queries:
        got = [(-int(np.floor(256 * np.float64(v)).astype(int) @ np.floor(256 * np.float64(x)).astype(int)), i) for i, x in rows if i != q and len(x) == len(v)]
        out[q] = [(-s, i) for s, i in sorted(got)[:k]]
    return out


def answers(df, queries, k=5):
    got = {}
    for r in sorted(mtree.top_k(df, queries, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    common = rng.normal(size=8)
    rows = [(i, (common if i % 3 == 0 else rng.normal(size=8) * (1 + i % 5)).tolist()) for i in range(1500)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    queries = [r for r in rows if r[0] % 50 == 0]
    got = answers(df, df.where("vec_id % 50 = 0"))
    assert got == best(rows, queries)


def test_bounds_save_distances():
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (40, 4))
    v = (centers[rng.integers(0, 40, 6000)] + rng.integers(-20, 20, (6000, 4))).astype(np.int64)
    t = mtree.MTree(v, np.arange(6000))
    for q in v[:20]:
        s = v @ q
        want = sorted((-int(a), i) for i, a in enumerate(s) if i != 3)[:5]
        assert t.search(q, 5, 3) == [(-a, i) for a, i in want]
    assert t.computed < 20 * 6000 / 4


def test_queries_together_get_what_each_gets_alone():
    rng = np.random.default_rng(12)
    centers = rng.integers(-900, 900, (20, 5))
    v = (centers[rng.integers(0, 20, 4000)] + rng.integers(-9, 9, (4000, 5))).astype(np.int64)
    ids = rng.permutation(8000)[:4000]
    t = mtree.MTree(v, ids)
    q = np.concatenate([v[:40], rng.integers(-900, 900, (20, 5))])
    skips = [int(i) for i in ids[:40]] + [-1] * 20
    alone = [t.search(x, 5, s) for x, s in zip(q, skips, strict=True)]
    t.computed = 0
    assert mtree.search_many(t, q, 5, skips, [None] * 60) == alone
    assert t.computed < 60 * 4000 / 3
    leasts = [a[-1][0] for a in alone]
    assert mtree.search_many(t, q, 5, skips, leasts) == alone
    few = mtree.MTree(v[:3], ids[:3])
    assert mtree.search_many(few, q, 5, skips, [None] * 60) == [few.search(x, 5, s) for x, s in zip(q, skips, strict=True)]
    big = mtree.MTree(v[:9] * (1 << 40), ids[:9])
    assert mtree.search_many(big, q[:4] * (1 << 30), 2, skips[:4], [None] * 4) == [big.search(x * (1 << 30), 2, s) for x, s in zip(q[:4], skips[:4], strict=True)]


def test_pages_give_the_tree_back_and_an_index_saves_distances(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 500)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 6)) * 30
    v = centers[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 6))
    t = mtree.MTree(np.floor(256 * v).astype(np.int64), np.arange(6000))
    again = mtree.MTree.of(t.pages())
    for q in np.floor(256 * v[:5]).astype(np.int64):
        assert again.search(q, 4, -1) == t.search(q, 4, -1) and again.computed == t.computed
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    index = mtree.build(df)
    assert index.trees >= 12 and index.pages.where("up >= 0 and radius > 0").count() > 0
    queries = df.where("vec_id % 50 = 0")
    assert mtree.search(index, queries).agg({"computed": "sum"}).first()[0] < 120 * 6000 / 4
    rows = [(i, x) for i, x in enumerate(v)]
    assert answers(df, queries) == best(rows, rows[::50])


def test_components_beyond_64_bits_stay_exact(spark):
    rows = [(i, [float(2.0**60 * (i + 1)), float(i)]) for i in range(3)] + [(50, [3.0, 4.0])]
    vectors = np.array([[int(np.floor(256 * x)) for x in v] for _, v in rows], object)
    assert (mtree.unpacked(mtree.packed(vectors), 2) == vectors).all()
    small = np.array([[1, -40000], [70000, 3]])
    assert (mtree.unpacked(mtree.packed(small), 2) == small).all() and len(mtree.packed(small)) == 17


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (7, [-0.001, 0.0]), (7, [-0.001, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(df, df.where("vec_id % 50 = 0"))
    part = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (7, [-0.001, 0.0]), (7, [-0.001, 0.0])]
    assert got == best(part, part[:2])
    assert answers(df.limit(0), df.limit(0)) == {} and answers(df, df.limit(0)) == {}


# ---- repeats


def brute(rows):
    """rows by doc_id, in stored order."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - suffix.LENGTH + 1):
            w = b[s : s + suffix.LENGTH]
            if w in seen:
                gone[s : s + suffix.LENGTH] = b"\1" * suffix.LENGTH
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts(n=80, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 7)))
    passages = [" ".join(word() for _ in range(rnd.randrange(20, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = [" ".join(word() for _ in range(rnd.randrange(0, 40))) for _ in range(3)]
        for _ in range(rnd.randrange(0, 3)):
            t.insert(rnd.randrange(len(t)), rnd.choice(passages))
        rows.append((i, " ".join(t)))
    return rows + [(n, "ab" * 400), (n + 1, "x" * 1000), (n + 2, None), (n + 3, ""), (n + 4, "ab" * 50), (n + 5, rows[3][1]), (n + 6, "é" * 300)]


def result(df, **more):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((*[r[c] for c in cols], bytes(r.kept)) for r in suffix.remove_repeats(df, **more).collect())


def test_repeats_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_spans int").repartition(5)
    want = sorted(brute(rows))
    assert sum(r[2] for r in want) > 5000
    assert result(df) == want
    # the way for hot grams gives the same
    assert result(df, hot=3) == want
    assert result(df.limit(0)) == []


def test_repeated_and_null_ids(spark):
    t = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id is not None, r.n_removed) for r in suffix.remove_repeats(df).collect())
    assert got == [(False, 0), (True, len(t)), (True, len(t))]


def test_anchors_of_steps_are_those_of_one():
    blob = os.urandom(3000) + b"abc" * 700 + os.urandom(500)
    sizes = np.array([1000, 99, 100, len(blob) - 1199])
    a, b = suffix.Anchors(blob, sizes), suffix.Anchors(blob, sizes, step=333)
    assert a.p.tolist() == b.p.tolist() and a.lo.tolist() == b.lo.tolist() and a.hi.tolist() == b.hi.tolist()
    served = np.zeros(len(blob), int)
    for lo, hi in [*zip(a.lo, a.hi + 1, strict=True), *zip(a.repeats[:, 0], a.repeats[:, 1] - suffix.LENGTH + 1, strict=True)]:
        served[lo:hi] += 1
    want = np.zeros(len(blob), int)
    at = 0
    for n in sizes:
        want[at : at + max(0, n - suffix.LENGTH + 1)] = 1
        at += n
    assert served.tolist() == want.tolist()


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(6)
    runs, keys = [], []
    for seg in range(7):
        k = [bytes(rnd.choice(b"ab\0") for _ in range(100)) + bytes(rnd.choice(b"xy") for _ in range(rnd.randrange(0, 60))) for _ in range(rnd.randrange(1, 60))]
        k += k[:3]
        n = len(k)
        keys += k
        runs.append(suffix.run_of(suffix.front_coded(k, np.arange(n), np.zeros(n, int), np.zeros(n, int), np.arange(n), np.full(n, seg))))
    got = list(suffix.merged(runs))
    assert [k for _, k, _ in got] == sorted(keys)
    for (_, a, _), (shared, b, _) in zip(got, got[1:], strict=False):
        assert shared == len(os.path.commonprefix([a, b]))
    assert list(suffix.merged([])) == []


def test_any_first_tree_gives_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 60)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3 + i % 2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 50 < 2")
    want = best(rows, [r for r in rows if r[0] % 50 < 2])
    assert answers(df, queries) == want
    monkeypatch.setattr(mtree, "ROOTS", 0)
    assert answers(df, queries) == want

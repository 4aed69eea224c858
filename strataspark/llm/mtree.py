"""Exact top-k by inner product with M-trees (operator 8).

Vectors become whole numbers, floor(256 * x). With one more coordinate, sqrt(M^2 - |x|^2) for rows and 0 for queries, a higher inner
product is a smaller distance, so an M-tree applies.

1. `build` deals the rows by their nearest pivot (PIVOTS of a sample of at most SAMPLE rows; every row is in the index) and loads
   them in bulk into trees of at most TREE_ROWS rows. A tree's pages are the rows of a table in the shared folder, written once: a
   routing object with its covering radius and its distance to the parent, and below the last of them up to PAGE entries
   with their vectors, ids and distances to it. Equal vectors are one entry with all their ids.
2. `search` packs the queries into blocks of about QUERY_BLOCK. Each query is first answered by the tree whose root scores best,
   which gives it a bound, and then by all other trees, blocks against trees dealt over all tasks. A query doesn't enter a tree whose
   root's ball lies beyond its bound. In a tree, nodes are visited best first; by the triangle inequality a stored distance
   to the parent rules out nodes and entries before their own distance is computed. Scores of what is left are exact
   whole-number products. A pack's queries go through a tree together. `computed` says how many distances it took.

Nothing of the table is gathered on the driver but the sample and at most ROOTS centers; neither queries nor trees are broadcast. Null vectors, and such with
null, NaN or infinite components or none at all, take no part; vectors of different lengths are not compared; null ids take no
part. A row with the query's own vec_id isn't its candidate. A query with fewer than k candidates gets all. Repeated query
ids count once (the vector that sorts first). Ids are whole numbers (other kinds are cast, or the job fails). An empty
table gives an empty result. Only id and vector are read, so other columns don't matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, parts, ready

PAGE = 64
FAN = 16
QUERY_BLOCK = 256
TREE_ROWS = 8192
PIVOTS, SAMPLE = 64, 4096
#: Trees up to which the centers of their roots (8 bytes a dimension) are compared with every query.
ROOTS = 4096
#: How much farther than the nearest query of a pack others may be from a node to visit it at once, as a share of the bound.
APART = 0.25
#: Share of a block that bounds leave from which on all of it is computed, as one product costs less.
DENSE = 0.5


class Node:
    __slots__ = ("center", "radius", "to_parent", "children", "entries", "dists")

    def __init__(self, center, radius, to_parent, children=None, entries=None, dists=None):
        self.center, self.radius, self.to_parent = center, radius, to_parent
        self.children, self.entries, self.dists = children, entries, dists


class MTree:
    """vectors: whole numbers, one row each; ids: of each row."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, seed: int = 1):
        uniq, to = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, to.ravel()))
        cuts = np.flatnonzero(np.diff(to.ravel()[order])) + 1
        self.ids = np.split(ids[order], cuts)
        self.v = uniq
        x = uniq.astype(np.float64)
        norms = (x * x).sum(1)
        self.m2 = float(norms.max())
        self.x = np.concatenate([x, np.sqrt(np.maximum(0, self.m2 - norms))[:, None]], axis=1)
        self.rng = np.random.default_rng(seed)
        self.root = self._load(np.arange(len(uniq)), None)
        self.computed = 0

    def pages(self) -> list[dict]:
        """The nodes, parents before children, as rows of the index."""
        out, todo = [], [(self.root, -1)]
        for node, up in todo:
            rows = node.entries if node.entries is not None else np.zeros(0, np.int64)
            out.append({
                "page": len(out), "up": up, "m2": self.m2, "leaf": node.entries is not None, "radius": node.radius, "to_parent": node.to_parent, "center": node.center.tobytes(),
                "vectors": packed(self.v[rows]), "dists": (node.dists if node.dists is not None else np.zeros(0)).tobytes(),
                "ids": np.concatenate([np.zeros(0, np.int64), *(self.ids[r] for r in rows)]).tobytes(), "sizes": np.array([len(self.ids[r]) for r in rows], np.int32).tobytes(),
            })
            todo += [(c, len(out) - 1) for c in node.children or ()]
        return out

    @classmethod
    def of(cls, pages: list[dict]) -> MTree:
        """The tree of such rows; no distance is computed."""
        t = cls.__new__(cls)
        t.m2, t.computed, t.ids, t.root = pages[0]["m2"], 0, [], None
        nodes, vectors, n = {}, [], 0
        for p in sorted(pages, key=lambda p: p["page"]):
            node = Node(np.frombuffer(p["center"]), p["radius"], p["to_parent"])
            if p["leaf"]:
                v = unpacked(p["vectors"], len(node.center) - 1)
                vectors.append(v)
                node.entries, node.dists = np.arange(n, n + len(v)), np.frombuffer(p["dists"])
                n += len(v)
                t.ids += np.split(np.frombuffer(p["ids"], np.int64), np.cumsum(np.frombuffer(p["sizes"], np.int32))[:-1])
            else:
                node.children = []
            nodes[p["page"]] = node
            if p["up"] < 0:
                t.root = node
            else:
                nodes[p["up"]].children.append(node)
        t.v = np.concatenate(vectors)
        return t

    def _load(self, rows: np.ndarray, parent: np.ndarray | None) -> Node:
        x = self.x[rows]
        center = x[int(((x - x.mean(0)) ** 2).sum(1).argmin())]
        far = np.sqrt(((x - center) ** 2).sum(1))
        to_parent = 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum()))
        if len(rows) <= PAGE:
            return Node(center, float(far.max()), to_parent, entries=rows, dists=far)
        fan = min(FAN, -(-len(rows) // PAGE))
        seeds = x[self.rng.choice(len(rows), fan, replace=False)]
        near = ((x * x).sum(1)[:, None] - 2 * x @ seeds.T + (seeds * seeds).sum(1)).argmin(1)
        groups = [rows[near == k] for k in range(fan)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # rows too alike to tell apart by these seeds
            groups = np.array_split(rows, fan)
        return Node(center, float(far.max()), to_parent, children=[self._load(g, center) for g in groups])

    def search(self, q: np.ndarray, k: int, skip: int, least: int | None = None) -> list[tuple[int, int]]:
        """The best (score, id), ties to the smaller id; the id `skip` is left out, and what scores below `least` may be."""
        y = np.append(q.astype(np.float64), 0.0)
        base = float((y * y).sum()) + self.m2
        slack = 1e-6 * (1 + base**0.5)
        found: list[tuple[int, int]] = []  # a heap: worst first, as (score, -id)
        limit = np.inf if least is None else max(0.0, base - 2 * least) ** 0.5  # the distance beyond which nothing counts
        self.computed += 1
        d = float(np.sqrt(((y - self.root.center) ** 2).sum()))
        heap = [(max(0.0, d - self.root.radius), 0, d, self.root)]
        n = 1
        while heap:
            low, _, d, node = heapq.heappop(heap)
            if low > limit + slack:
                break
            if node.entries is None:
                for c in node.children:
                    if abs(d - c.to_parent) - c.radius > limit + slack:
                        continue
                    self.computed += 1
                    dc = float(np.sqrt(((y - c.center) ** 2).sum()))
                    bound = max(0.0, dc - c.radius)
                    if bound <= limit + slack:
                        heapq.heappush(heap, (bound, n, dc, c))
                        n += 1
                continue
            rows = node.entries[np.abs(d - node.dists) <= limit + slack]
            self.computed += len(rows)
            scores = self.v[rows] @ q
            if len(found) == k:
                good = scores >= found[0][0]
                rows, scores = rows[good], scores[good]
            for i in np.argsort(-scores, kind="stable"):
                s = int(scores[i])
                if len(found) == k and s < found[0][0]:
                    break
                for at, e in enumerate(self.ids[rows[i]]):
                    if at > k:  # the ids are sorted: one may be skipped, the first k others are enough
                        break
                    if e == skip:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, (s, -int(e)))
                    elif (s, -int(e)) > found[0]:
                        heapq.heapreplace(found, (s, -int(e)))
            if len(found) == k:
                limit = min(limit, max(0.0, base - 2 * found[0][0]) ** 0.5)
        return sorted(((s, -e) for s, e in found), key=lambda x: (-x[0], x[1]))


def search_many(t: MTree, queries: np.ndarray, k: int, skips: list[int], leasts: list[int | None]) -> list[list[tuple[int, int]]]:
    """search() for several queries (rows of whole numbers) at once: a node is visited if it may hold something for one of them, best bound
    first, and what is computed there is one product of matrices, for the queries and entries that bounds leave."""
    most = max(1, int(abs(t.v).max())) * max(1, int(abs(queries).max())) * t.v.shape[1]
    if t.v.dtype == object or queries.dtype == object or most >= 1 << 52:
        return [t.search(q, k, s, low) for q, s, low in zip(queries, skips, leasts, strict=True)]
    y = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1)
    base = (y * y).sum(1) + t.m2
    slack = 1e-6 * (1 + np.sqrt(base))
    limit = np.array([np.inf if low is None else max(0.0, b - 2 * low) ** 0.5 for b, low in zip(base, leasts, strict=True)])
    found: list[list[tuple[int, int]]] = [[] for _ in queries]  # the best so far, best first, as (-score, id)

    def near(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        t.computed += len(rows)
        return np.sqrt(((y[rows] - center) ** 2).sum(1))

    rows = np.arange(len(queries))
    d = near(rows, t.root.center)
    heap = [(float((d - t.root.radius).min()), 0, rows, d, t.root)]
    n = 1
    while heap:
        _, _, rows, d, node = heapq.heappop(heap)
        ok = d - node.radius <= (limit + slack)[rows]
        rows, d = rows[ok], d[ok]
        if not len(rows):
            continue
        low = d - node.radius
        far = low > low.min() + APART * min(limit[rows].min(), d.min())
        if far.any() and not far.all():
            # others have nearer nodes to visit first, which may rule this one out
            heapq.heappush(heap, (float(low[far].min()), n, rows[far], d[far], node))
            n, rows, d = n + 1, rows[~far], d[~far]
        if node.entries is None:
            for c in node.children:
                ok = np.abs(d - c.to_parent) - c.radius <= (limit + slack)[rows]
                if ok.any():
                    below = rows[ok]
                    dc = near(below, c.center)
                    gap = dc - c.radius - (limit + slack)[below]
                    if gap.min() <= 0:
                        heapq.heappush(heap, (float((dc - c.radius)[gap <= 0].min()), n, below[gap <= 0], dc[gap <= 0], c))
                        n += 1
            continue
        may = np.abs(d[:, None] - node.dists) <= (limit + slack)[rows][:, None]
        rows, may = rows[may.any(axis=1)], may[may.any(axis=1)]
        entries, may = node.entries[may.any(axis=0)], may[:, may.any(axis=0)]
        if not len(rows):
            continue
        if may.mean() > DENSE:
            t.computed += may.size
            scores = y[rows, :-1] @ t.v[entries].T.astype(np.float64)
        else:
            # few of the block's pairs are left: only these
            i, j = np.nonzero(may)
            t.computed += len(i)
            scores = np.full(may.shape, -np.inf)
            scores[i, j] = (y[rows[i], :-1] * t.v[entries[j]]).sum(1)
        worst = np.array([-found[r][-1][0] if len(found[r]) == k else -np.inf for r in rows])
        for i in np.flatnonzero(((scores >= worst[:, None]) & (scores > -np.inf)).any(axis=1)).tolist():
            r = rows[i]
            good = np.flatnonzero((scores[i] >= worst[i]) & (scores[i] > -np.inf))
            if len(good) > 4 * k:
                good = good[scores[i][good] >= -np.partition(-scores[i][good], k)[k]]  # one may be skipped, k others are enough
            new = [(-int(scores[i][j]), int(e)) for j in good for e in t.ids[entries[j]][: k + 1] if e != skips[r]]
            found[r] = sorted(found[r] + new)[:k]
            if len(found[r]) == k:
                limit[r] = min(limit[r], max(0.0, base[r] + 2 * found[r][-1][0]) ** 0.5)
    return [[(-s, e) for s, e in x] for x in found]


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them, or as text beyond 64 bits; the first byte says which."""
    if v.dtype == object:
        return b"\0" + " ".join(map(str, v.ravel())).encode()
    most = max(int(v.max()), -int(v.min())) if v.size else 0
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([size]) + v.astype(f"<i{size}").tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    if raw[0]:
        return np.frombuffer(raw, f"<i{raw[0]}", -1, 1).reshape(-1, width).astype(np.int64)
    return np.array([int(x) for x in raw[1:].split()], object).reshape(-1, width)


def whole(col: pa.Array, ids: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: vectors as whole numbers and their ids, without what takes no part."""
    by: dict[int, tuple[list, list]] = {}
    for v, i in zip(col, ids.to_pylist(), strict=True):
        if i is None or not v.is_valid or not len(v) or v.values.null_count:
            continue
        x = np.floor(256.0 * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all():
            got = by.setdefault(len(x), ([], []))
            got[0].append(x)
            got[1].append(i)
    # products stay exact in 64 bits up to components of 2**28; beyond that in Python's numbers
    return {n: (a if max(map(abs, (a.min(), a.max()))) < 1 << 28 else a.astype(object), np.array(i, np.int64)) for n, (v, i) in by.items() for a in [_ints(np.array(v))]}


def _ints(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if np.abs(x).max() < 2.0**62 else np.array([[int(c) for c in r] for r in x], object)


_FIELDS = {
    "size": "int", "tree": "long", "pivot": "int", "page": "int", "up": "int", "m2": "double", "leaf": "boolean", "radius": "double", "to_parent": "double",
    "center": "binary", "vectors": "binary", "dists": "binary", "ids": "binary", "sizes": "binary",
}
_PAGE = [*_FIELDS][3:]


def _rows(df: DataFrame, id_col: str, vec_col: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """size, pivot, i, v: the vectors that take part, as whole numbers, and the pivot that is nearest."""

    def nearest(size: int, v: np.ndarray) -> np.ndarray:
        p = pivots.get(size)
        return np.zeros(len(v), np.int64) if p is None else ((p * p).sum(1) - 2 * v.astype(np.float64) @ p.T).argmin(1)

    def run(batches):
        for b in batches:
            for size, (v, i) in whole(b.column(1), b.column(0)).items():
                cols = [pa.array(np.full(len(i), size), pa.int32()), pa.array(nearest(size, v), pa.int32()), pa.array(i), pa.array([packed(r) for r in v], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["size", "pivot", "i", "v"])

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).mapInArrow(run, "size int, pivot int, i long, v binary")


def _pivots(df: DataFrame, id_col: str, vec_col: str) -> dict[int, np.ndarray]:
    """By length of vector: rows of a sample (those of the least hashes), each farthest from those before."""
    t = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).where("i is not null and size(v) > 0").orderBy(F.xxhash64("i"), "i").limit(SAMPLE).toArrow().combine_chunks()
    out = {}
    if t.num_rows:
        for size, (v, _) in whole(t["v"].combine_chunks(), t["i"].combine_chunks()).items():
            x = np.unique(v.astype(np.float64), axis=0)
            far, chosen = np.full(len(x), np.inf), [0]
            while len(chosen) < min(PIVOTS, len(x)):
                far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
                if not far.max():
                    break
                chosen.append(int(far.argmax()))
            out[size] = x[chosen]
    return out


class Index:
    """pages: a table, a row for each page. trees: how many there are, numbered from 0."""

    def __init__(self, pages: DataFrame, trees: int, pivots: dict[int, np.ndarray]):
        self.pages, self.trees, self.pivots = pages, trees, pivots


def build(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """An index of every row, dealt by length, nearest pivot and id, so that a hot pivot is split."""
    spark = ready(df.sparkSession)
    pivots = _pivots(df, id_col, vec_col)
    order = ["size", "pivot", "i"]
    dealt = _rows(df, id_col, vec_col, pivots).repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, n, held, key = TaskContext.get().partitionId(), 0, [], None
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

        def tree():
            nonlocal n, held
            t = MTree(np.concatenate([unpacked(v, key[0]) for _, v in held]), np.array([i for i, _ in held], np.int64))
            made = [{"size": key[0], "tree": part << 32 | n, "pivot": key[1], **p} for p in t.pages()]
            n, held = n + 1, []
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in made], kinds[k]) for c, k in _FIELDS.items()], [*_FIELDS])

        for b in batches:
            for size, pivot, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # a tree's rows are of one length; a new pivot begins one if the last is fairly full
                if held and (size != key[0] or len(held) == TREE_ROWS or pivot != key[1] and len(held) > TREE_ROWS // 2):
                    yield tree()
                if not held:
                    key = (size, pivot)
                held.append((i, v))
        if held:
            yield tree()

    pages = cut(dealt.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in _FIELDS.items())), "mtree")
    # running numbers of trees: those of the tasks before, and those in the task
    part = F.shiftright("tree", 32)
    by_part = pages.where("up < 0").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = by_part.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    trees = by_part.agg(F.sum("n")).first()[0] or 0
    pages = pages.withColumn("part", part).join(F.broadcast(ahead.drop("n")), "part").withColumn("tree", F.col("ahead") + F.col("tree").bitwiseAND(F.lit(0xFFFFFFFF)))
    return Index(pages.select(*_FIELDS), trees, pivots)


def _answered(packs: DataFrame, index: Index, k: int) -> DataFrame:
    """packs: tree, and asked, a list of (i, size, v, home, least). The best k of each in its tree; queries at home elsewhere than in the
    tree have a bound, those at home in it are left out if they have been answered."""
    n = parts(packs.sparkSession)
    held = index.pages.groupBy("tree").agg(F.collect_list(F.struct(*_PAGE)).alias("pages"))
    both = packs.repartition(n, "tree").join(held.repartition(n, "tree"), "tree").select("tree", "pages", "asked")

    def run(batches):
        last, t = None, None
        for b in batches:
            out = []
            for tree, pages, asked in zip(*b.columns, strict=True):
                if tree.as_py() != last:
                    last, t = tree.as_py(), MTree.of(pages.as_py())
                width = len(t.root.center) - 1
                own = [q for q in asked.as_py() if q["size"] == width]
                if not own:
                    continue
                t.computed = 0
                got = search_many(t, np.concatenate([unpacked(q["v"], width) for q in own]), k, [q["i"] for q in own], [q["least"] for q in own])
                out += [(q["i"], s, e, 0) for q, found in zip(own, got, strict=True) for s, e in found]
                out.append((own[0]["i"], None, None, t.computed))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], ["query_id", "score", "vec_id", "computed"])

    return both.mapInArrow(run, "query_id long, score long, vec_id long, computed long")


def _at_home(asked: DataFrame, index: Index) -> DataFrame:
    """i, size, v and home, the tree that a query is answered by first: that whose root scores best, or, if there are more than ROOTS trees, the
    first of the query's pivot (or length). Any choice gives the same result."""
    roots = index.pages.where("up < 0")
    if index.trees > ROOTS:
        # a tree of each pivot, and one of each length: as many rows as pivots
        of_pivot = roots.groupBy("size", "pivot").agg(F.min("tree").alias("own"))
        of_size = roots.groupBy("size").agg(F.min("tree").alias("any"))
        placed = asked.join(F.broadcast(of_pivot), ["size", "pivot"], "left").join(F.broadcast(of_size), "size")
        return placed.select("i", "size", "v", F.coalesce("own", "any").alias("home"))
    by: dict[int, tuple[list, list]] = {}
    for r in roots.select("size", "tree", "center").orderBy("tree").collect():
        ids, centers = by.setdefault(r["size"], ([], []))
        ids.append(r.tree)
        centers.append(np.frombuffer(r.center)[:-1])
    shared = asked.sparkSession.sparkContext.broadcast({n: (np.array(i, np.int64), np.array(c)) for n, (i, c) in by.items()})

    def run(batches):
        for b in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[1] in shared.value]
            home = [int(ids[(centers @ unpacked(v, n)[0].astype(np.float64)).argmax()]) for _, n, v in rows for ids, centers in [shared.value[n]]]
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], home]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["i", "size", "v", "home"])

    return asked.select("i", "size", "v").mapInArrow(run, "i long, size int, v binary, home long")


def search(index: Index, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, score, vec_id: the best of the trees that each query entered, its k best of all among them, and computed, the distances
    that took (of a pack in a tree; in a row without a score)."""
    spark = ready(queries.sparkSession)
    asked = _rows(queries, id_col, vec_col, index.pivots).groupBy("i").agg(F.min(F.struct("size", "v", "pivot")).alias("x")).select("i", "x.*")
    placed = cut(_at_home(asked, index), "asked")
    per_home = placed.groupBy("home").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))

    def packs(t: DataFrame) -> DataFrame:
        spread = F.pmod(F.xxhash64("i"), F.col("blocks"))
        return t.join(F.broadcast(per_home), "home").groupBy("home", spread.alias("block")).agg(F.collect_list(F.struct("i", "size", "v", "home", "least")).alias("asked"))

    first = cut(_answered(packs(placed.withColumn("least", F.lit(None).cast("long"))).withColumnRenamed("home", "tree"), index, k), "at_home")
    bound = first.where("score is not null").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select(F.col("query_id").alias("i"), "least")
    others = packs(placed.join(bound, "i", "left")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(max(0, index.trees - 1))).cast("array<long>"))).where("tree <> home")
    out = cut(first.union(_answered(others.select("tree", "asked"), index, k)), "found")
    discard(first, placed)
    return out


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    found = search(build(df, id_col, vec_col), queries, k, id_col, vec_col).where("score is not null")
    # k rows for each query and tree that it entered
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

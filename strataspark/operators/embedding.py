"""Graph embedders: walks, context pairs, node2vec by Word2Vec, TransE, and propagated features."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l1
from ..plans.staging import ready, staged
from .graph import adjacency, degree_features, propagate


def _draw(*cols: Column) -> Column:
    """A number in [0, 1) that follows from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / float(1 << 53)


#: Draws that a step tries at once: for all walks first, then for those that found none.
TRIES = (4, 32)


def walks(neighbors: DataFrame, length: int = 10, per_node: int = 2, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """Biased second-order random walks (qid, walk_no, walk). neighbors: (qid, neighbors), an array. A step's odds are 1/p back to
    where it came from, 1 to neighbours of that node, 1/q elsewhere. All walks advance a step at a time; draws are hashes of seed,
    start, number, step and try, so that results repeat. A node without neighbours ends its walks.

    A step goes back with its share of the odds, if the greater of 1 and 1/q counts for every other neighbour; else it takes any
    neighbour but that and keeps it with its odds over that greater number, or draws again, as often as it takes. A draw looks up one
    edge by its number and one by its ends, so a node's neighbours never meet its walks as a whole."""
    most = max(1.0, 1.0 / q)
    edges = staged(neighbors.select("qid", F.size("neighbors").alias("deg"), F.posexplode("neighbors").alias("i", "v")), "edges")
    ends = edges.select(F.col("qid").alias("a"), F.col("v").alias("b"), F.lit(True).alias("linked")).distinct()
    size = neighbors.select(F.col("qid").alias("v"), F.size("neighbors").alias("v_deg"))
    # of each edge also the degree of where it leads, and whether one leads back
    to = edges.drop("deg").join(size, "v", "left").join(ends.select(F.col("a").alias("v"), F.col("b").alias("qid"), "linked"), ["v", "qid"], "left")
    to = staged(to.select(F.col("qid").alias("at"), "i", "v", F.coalesce("v_deg", F.lit(0)).alias("v_deg"), F.coalesce("linked", F.lit(False)).alias("v_back")), "edges")
    w = neighbors.select(F.col("qid").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk_no"), F.array("qid").alias("walk"), F.size("neighbors").alias("deg"), F.lit(0).alias("prev_deg"), F.lit(False).alias("back"))
    for step in range(1, length):
        draw = lambda of, t, step=step: _draw(F.lit(seed), "start", "walk_no", F.lit(step), t, F.lit(of))
        live = (F.size("walk") == step) & (F.col("deg") > 0)
        done, left, tried = w.where(~live), w.where(live), 0
        while True:
            n = TRIES[min(tried, 1)] if step > 1 else 1
            home = F.when(F.col("back"), 1.0 / p).otherwise(0.0)
            # of all places, since the place of where it came from is drawn too, and refused; a node with no other place only goes back
            rest = F.when(F.col("back") & (F.col("deg") == 1), 0.0).otherwise(F.col("deg") * most)
            x = left.withColumn("returns", F.filter(F.sequence(F.lit(tried), F.lit(tried + n - 1)), lambda t: draw("return", t) * (home + rest) < home))  # noqa: B023
            before = F.coalesce(F.get("returns", 0), F.lit(tried + n))
            t = x.where(before > tried).select("start", "walk_no", F.element_at("walk", -1).alias("at"), F.element_at("walk", -2).alias("prev") if step > 1 else F.lit(None).cast("string").alias("prev"), "deg", F.explode(F.sequence(F.lit(tried), before - 1)).alias("t"))
            t = t.withColumn("i", F.least(F.floor(draw("place", F.col("t")) * F.col("deg")), F.col("deg") - 1).cast("int")).withColumn("odds", draw("keep", F.col("t")) * most)
            t = t.join(to, ["at", "i"])
            if step > 1:
                t = t.where("v <> prev")
                if q != 1:
                    t = t.join(ends.select(F.col("a").alias("prev"), F.col("b").alias("v"), "linked"), ["prev", "v"], "left")
                    t = t.where(F.col("odds") < F.when(F.col("linked"), 1.0).otherwise(1.0 / q))
            best = t.groupBy("start", "walk_no").agg(F.min(F.struct("t", "v", "v_deg", "v_back")).alias("best"))
            goes = F.when(F.col("best").isNotNull(), F.struct(F.col("best.v").alias("v"), F.col("best.v_deg").alias("deg"), F.col("best.v_back").alias("back")))
            if step > 1:
                goes = goes.when(F.size("returns") > 0, F.struct(F.element_at("walk", -2).alias("v"), F.col("prev_deg").alias("deg"), F.lit(True).alias("back")))
            x = staged(x.join(best, ["start", "walk_no"], "left").withColumn("goes", goes).drop("returns", "best"), "walks")
            done = done.unionByName(x.where("goes is not null").select("start", "walk_no", F.array_append("walk", F.col("goes.v")).alias("walk"), F.col("goes.deg").alias("deg"), F.col("deg").alias("prev_deg"), F.col("goes.back").alias("back")))
            left, tried = x.where("goes is null").drop("goes"), tried + n
            if left.isEmpty():
                break
        w = done
    return w.select(F.col("start").alias("qid"), "walk_no", "walk")


def context_pairs(seqs: DataFrame, keys: list[str], pos: str, item: str, window: int) -> DataFrame:
    """(center, context, offset): items at most `window` places apart in a sequence, self left out. Neighbours come by lag and
    lead, so a sequence isn't joined with itself."""
    w = Window.partitionBy(*keys).orderBy(pos)
    offsets = [d for d in range(-window, window + 1) if d]
    near = F.array(*[F.struct(F.lag(item, -d).over(w).alias("context"), F.lit(d).alias("offset")) for d in offsets])
    return seqs.withColumn("__near", near).select(*keys, pos, F.col(item).alias("center"), F.explode("__near").alias("x")).where("x.context is not null").select(*keys, pos, "center", F.col("x.context").alias("context"), F.col("x.offset").alias("offset"))


def node2vec(found: DataFrame, size: int = 128, window: int = 5, seed: int = 1, iterations: int = 1) -> DataFrame:
    """(qid, embedding) by Spark's Word2Vec (skip-gram) over walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    m = Word2Vec(vectorSize=size, windowSize=window, seed=seed, minCount=0, maxIter=iterations, inputCol="walk", outputCol="v").fit(found)
    return m.getVectors().select(F.col("word").alias("qid"), vector_to_array("vector").alias("embedding"))


def negative_edges(edges: DataFrame, nodes: DataFrame, seed: int = 0, tries: int = 100) -> DataFrame:
    """For each edge a corrupted one: head or tail replaced by a hashed draw among all nodes. Draws that give an existing edge are
    drawn again. An edge that still has none after so many tries, as in a graph with all edges, is an error."""
    n = nodes.count()
    at = F.row_number().over(Window.partitionBy("bin").orderBy("qid")) - 1
    binned = nodes.select("qid", F.pmod(F.xxhash64("qid"), F.lit(max(1, n // 64))).alias("bin")).withColumn("at", at)
    sizes = binned.groupBy("bin").agg(F.count("*").alias("size"))
    real = edges.select(F.col("parent_qid").alias("neg_parent"), F.col("child_qid").alias("neg_child"))
    left, out = edges.select("parent_qid", "child_qid"), None
    for k in range(tries):
        h = lambda i, *cols, k=k: F.xxhash64(*cols, F.lit(seed + i), *([F.lit(k)] if k else []))
        drawn = left.withColumn("bin", F.pmod(h(0, "parent_qid", "child_qid"), F.lit(max(1, n // 64)))).join(sizes, "bin", "left")
        drawn = drawn.withColumn("at", F.pmod(h(1, "child_qid", "parent_qid"), F.col("size")).cast("int")).join(binned, ["bin", "at"], "left")
        head = F.pmod(h(2, "parent_qid", "child_qid"), F.lit(2)) == 0
        bad = drawn.select("parent_qid", "child_qid", F.when(head, F.col("qid")).otherwise(F.col("parent_qid")).alias("neg_parent"), F.when(head, F.col("child_qid")).otherwise(F.col("qid")).alias("neg_child"))
        # an empty bin gives no node: drawn again too
        known = real.withColumn("known", F.lit(True)).distinct()
        bad = staged(bad.join(known, ["neg_parent", "neg_child"], "left").withColumn("again", F.col("known").isNotNull() | F.col("neg_parent").isNull() | F.col("neg_child").isNull()), "negatives")
        good = bad.where("not again").select("neg_parent", "neg_child", "parent_qid", "child_qid")
        out = good if out is None else out.union(good)
        left = bad.where("again").select("parent_qid", "child_qid")
        if left.isEmpty():
            return out
    raise ValueError(f"edges without a corrupted one after {tries} draws")


def transe_distance(h: Column, r: Column, t: Column) -> Column:
    """L1 norm of h + r - t."""
    return l1(F.zip_with(F.zip_with(h, r, lambda x, y: x + y), t, lambda x, y: x - y))


#: Edges that a step takes at once, and repeats of a row from which they are summed before they are added.
AT_ONCE, REPEATS = 4096, 8
#: Threads of the one task that trains; NumPy lets them run side by side.
THREADS = 2


def _rows(x: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Copies of rows in the first of out: fresh memory for each block would take longer than the work in it."""
    return np.take(x, at, axis=0, out=out[: len(at)], mode="clip")


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray, sign: int, spare: np.ndarray) -> None:
    """Adds each row, or takes it off, where its number says, which may repeat."""
    order = np.argsort(at, kind="stable")
    at, rows = at[order], _rows(rows, order, spare[0])
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    ends = np.append(starts[1:], len(at))
    many = ends - starts >= REPEATS
    for a, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
        to[at[a]] += np.full(e - a, sign, rows.dtype) @ rows[a:e]
    starts, ends = starts[~many], ends[~many]
    while len(starts):
        # one of each number at a time, so that none repeats
        known = _rows(to, at[starts], spare[1])
        (np.add if sign > 0 else np.subtract)(known, rows if len(starts) == len(at) else _rows(rows, starts, spare[2]), out=known)
        to[at[starts]] = known
        left = starts + 1 < ends
        starts, ends = starts[left] + 1, ends[left]


def _to_signs(x: np.ndarray, flags: np.ndarray) -> None:
    """-1, 0 and 1 in place of numbers; np.sign takes many times as long in place."""
    above, below = flags[:, : len(x)]
    np.greater(x, 0, out=above)
    np.less(x, 0, out=below)
    x[:] = np.subtract(above.view(np.int8), below.view(np.int8), out=below.view(np.int8))


def _to_unit(e: np.ndarray) -> np.ndarray:
    e /= np.maximum(np.sqrt(np.einsum("ij,ij->i", e, e)), 1e-12)[:, None]
    return e


def transe_steps(h: np.ndarray, t: np.ndarray, n: int, size: int, epochs: int, rate: float, margin: float, seed: int) -> tuple[np.ndarray, list]:
    """Vectors of n nodes after full-batch steps over edges from h to t, and (epoch, average_loss, margin_hits).

    A vector is a row, and a step goes over edges in blocks: each end's row is fetched once, and signs are added up only for edges within
    the margin. Sums of signs are whole numbers, so their order and the threads don't matter."""
    m, rng = len(h), np.random.default_rng(seed)
    bound = 6 / size**0.5
    e = np.empty((n, size), np.float32)
    for k in range(size):
        e[:, k] = rng.uniform(-bound, bound, n)
    r, out = rng.uniform(-bound, bound, size), []
    parts = [slice(a, a + AT_ONCE) for a in range(0, n, AT_ONCE)]
    for part in parts:
        _to_unit(e[part])
    r /= max(np.linalg.norm(r), 1e-12)
    # draws are in the order of the given edges, steps in that of their tails, whose rows then lie near each other
    order = np.argsort(t, kind="stable")
    h, t = h[order], t[order]
    ones, sums, touched = np.ones(size, np.float32), np.zeros_like(e), np.zeros(n, bool)
    spare, alone = np.empty((3, 2 * AT_ONCE, size), np.float32), Lock()
    # of each thread: rows of a block; edges within the margin that wait for their sums, with another tail and with another head (how many,
    # their ends, their differences); signs of these
    room = [np.empty((3, AT_ONCE, size), np.float32) for _ in range(THREADS)]
    waits = [[[0, np.empty((3, 2 * AT_ONCE), np.int64), np.empty((2, 2 * AT_ONCE, size), np.float32)] for _ in range(2)] for _ in range(THREADS)]
    signs = [(np.empty((2, 2 * AT_ONCE, size), bool), np.empty((2 * AT_ONCE, size), np.float32)) for _ in range(THREADS)]

    def add(w, head, slope):
        wait, (flags, rows) = waits[w][head], signs[w]
        if not wait[0]:
            return
        c, (i, j, k), (pos, neg) = wait[0], wait[1][:, : wait[0]], wait[2][:, : wait[0]]
        _to_signs(pos, flags)
        _to_signs(neg, flags)
        both = np.subtract(pos, neg, out=rows[:c])
        with alone:
            slope += np.ones(c, np.float32) @ both
            _add_rows(sums, i, pos if head else both, 1, spare)
            _add_rows(sums, j, both if head else pos, -1, spare)
            _add_rows(sums, k, neg, -1 if head else 1, spare)
            touched[i] = touched[j] = touched[k] = True
        wait[0] = 0

    def compare(w, bad, heads, y, loss, slope):
        first, second, third = room[w]
        for a in range(w * AT_ONCE, m, THREADS * AT_ONCE):
            of = heads[a : a + AT_ONCE]
            for head, at in ((1, a + np.flatnonzero(of)), (0, a + np.flatnonzero(~of))):
                i, j, k = h[at], t[at], bad[at]
                if head:
                    x, pos, neg = _rows(e, j, third), _rows(e, i, first), _rows(e, k, second)
                    x -= y
                    pos -= x
                    neg -= x
                else:
                    neg, pos, x = _rows(e, i, second), _rows(e, j, first), _rows(e, k, third)
                    neg += y
                    np.subtract(neg, pos, out=pos)
                    neg -= x
                far = np.abs(pos, out=x) @ ones
                far -= np.abs(neg, out=x) @ ones
                far += margin
                loss[at] = far
                hit = np.flatnonzero(far > 0)
                c, ends, rows = wait = waits[w][head]
                ends[:, c : c + len(hit)] = i[hit], j[hit], k[hit]
                _rows(pos, hit, rows[0][c:])
                _rows(neg, hit, rows[1][c:])
                wait[0] += len(hit)
                if wait[0] > AT_ONCE:
                    add(w, head, slope)

    def move(w):
        for part in parts[w::THREADS]:
            # other vectors don't change
            some = np.flatnonzero(touched[part]) + part.start
            x, g = _rows(e, some, room[w][0]), _rows(sums, some, room[w][1])
            g *= np.float32(rate)
            x -= g
            e[some] = _to_unit(x)
            sums[some] = 0

    with ThreadPoolExecutor(THREADS) as pool:
        for epoch in range(1, epochs + 1):
            bad = rng.integers(0, n, m)[order]
            heads = (rng.random(m) < 0.5)[order]
            loss, slope, y = np.empty(m), np.zeros(size), r.astype(np.float32)
            list(pool.map(lambda w: compare(w, bad, heads, y, loss, slope), range(THREADS)))  # noqa: B023
            for w in range(THREADS):
                add(w, 0, slope)
                add(w, 1, slope)
            list(pool.map(move, range(THREADS)))
            touched[:] = False
            r -= rate * slope / max(1, m)
            out.append((epoch, float(np.maximum(loss, 0).mean()), int((loss > 0).sum())))
    return e, out


def transe(edges: DataFrame, size: int = 32, epochs: int = 20, rate: float = 0.01, margin: float = 1.0, seed: int = 0, limit: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """TransE with one relation by margin steps, (qid, embedding) and a trace (epoch, average_loss, margin_hits). The model lives in
    one task, so graphs of more than `limit` edges are refused rather than cut."""
    ready(edges.sparkSession)
    n = edges.count()
    if n > limit:
        raise ValueError(f"{n} edges; a model in one task takes {limit}")

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        pairs = pa.Table.from_batches(batches)
        names = pc.unique(pa.chunked_array([*pairs["parent_qid"].chunks, *pairs["child_qid"].chunks]))
        names = names.take(pc.sort_indices(names))
        h, t = (pc.index_in(pairs[c], value_set=names).to_numpy().astype(np.int64) for c in ("parent_qid", "child_qid"))
        order = np.lexsort((t, h))
        n = len(names)
        e, out = transe_steps(h[order], t[order], n, size, epochs, rate, margin, seed)
        columns = ["kind", "qid", "embedding", "epoch", "average_loss", "margin_hits"]
        for at in range(0, n, 8192):
            v = e[at : at + 8192]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * size, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(["e"] * len(v)), names.slice(at, len(v)), lists, *[pa.nulls(len(v), k) for k in (pa.int32(), pa.float64(), pa.int64())]], columns)
        yield pa.RecordBatch.from_arrays([pa.array(["t"] * len(out), pa.string()), pa.nulls(len(out), pa.string()), pa.nulls(len(out), pa.list_(pa.float32())), *[pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.float64(), pa.int64()))]], columns)

    both = staged(edges.select("parent_qid", "child_qid").repartition(1).mapInArrow(run, "kind string, qid string, embedding array<float>, epoch int, average_loss double, margin_hits long"), "transe")
    return both.where("kind = 'e'").select("qid", F.col("embedding").cast("array<double>").alias("embedding")), both.where("kind = 't'").select("epoch", "average_loss", "margin_hits")


def propagated(nodes: DataFrame, edges: DataFrame, layers: int = 2, symmetric: bool = True) -> DataFrame:
    """Degree features after so many steps of normalized message passing: what a graph convolution sees, without weights."""
    cols = ["f_degree", "f_in", "f_out", "f_log"]
    x = degree_features(nodes, edges)
    adj = staged(adjacency(nodes, edges, symmetric), "adjacency")
    for _ in range(layers):
        x = propagate(adj, x, cols)
    return x


def sampled_neighbors(neighbors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k neighbours of each node, by an MD5 that any engine can repeat."""
    keyed = F.transform("neighbors", lambda v: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "qid", v)).alias("h"), v.alias("v")))
    return neighbors.select("qid", F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["v"]).alias("neighbors"))


def dropped_edges(edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Edges that stay when each goes with odds `share`."""
    return edges.where(_draw(F.lit(seed), "parent_qid", "child_qid") >= share)

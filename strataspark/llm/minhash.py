"""Near-duplicates by HyperMinHash registers (operator 4).

A text's words are those of `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; its set is that of its k-word shingles (the whole
sequence as one, if it has fewer words). Two texts link if their sets' Jaccard similarity reaches `percent`/100.

1. `sketch` (one pass over the texts): 64-bit shingle hashes, the set's size and 128-bit digest, and BANDS x BUCKETS
   registers. A band hashes the set anew, deals it to its buckets, and keeps of each bucket's least hash the count of
   leading zeros (6 bits) and ROOT_BITS bits that follow. The four 16-bit registers of a band are its key. A pair that
   reaches 0.85 agrees in no band with a probability of about 5e-8 (0.8: 2e-6).
2. Equal sets are one class with a number of its own; only classes go on, and only such as are large enough to link with another.
3. Candidates are classes that share a key and whose similarity as estimated from the registers (corrected for registers
   that agree by accident) reaches CUT (at 0.85 that loses 2e-8); their components are clusters. To find these, each band's classes
   are sorted by key, then by the next band's key, over all tasks alike, and neighbours with equal keys are estimated: as many
   pairs as classes and bands, however large a group is. Keys whose classes then still lie in several clusters are
   searched in packs for bridges between clusters.
4. A cluster is dealt into blocks of about BLOCK classes, whose full sets meet in one task: all intersections of a block are one
   product of matrices, so all its links are known exactly.
5. Clusters of several blocks: for each two parts, the candidate of best estimate is confirmed on the full sets. Then every class outside of
   its cluster's largest component is held against all classes of the cluster, packs against packs, again by products of matrices.
   Classes of whose shingles too many stand in no other set of the cluster can't link and are left out.

So every link between candidates is found, and what tasks emit is a link for each two parts at most: no group is expanded into its pairs,
and no task holds more than two packs. Null doc_ids take no part in links: such rows have no component_id and are kept. Texts that are
null or have no word have an empty set and no links, and are kept. Texts of any length have one set, 8 bytes for each distinct shingle. Of
a table with repeated doc_ids each row's n_shingles is that of its own text; the texts of an id are one document otherwise, linked
with all that any of them links with. Clashing columns don't matter (only id and text are read). Ids may be of any kind that has an
order. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, extend, parts, ready, texts
from .components import components, joined

BANDS, BUCKETS, ROOT_BITS = 24, 4, 10
CUT = 0.6
BLOCK = 512
#: Bytes of a pack's sets or registers, unless one is larger.
PACK_BYTES = 4_000_000
#: Rows (up to 50 bytes) up to which a table of ids or keys is broadcast to a scan; beyond that both sides are shuffled.
SMALL_IDS = 500_000
#: Columns of a product of matrices.
WIDTH = 4096
EMPTY = 0xFFFF
#: Odds that registers of unlike values agree: equal counts of zeros (a third), then equal bits.
ACCIDENT = 2.0**-ROOT_BITS / 3

_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class Shingles:
    """Sorted distinct shingle hashes of texts; words' hashes are kept in a bounded memo."""

    def __init__(self, words: int):
        self.k, self.memo = words, {}

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "replace").lower().split()  # of bytes: just A-Z, and just the six ASCII spaces
        if not found:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > 150_000:
            memo.clear()
        for w in set(found):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * _M2 + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The least hash (62 bits) of each band's buckets; all ones where a bucket is empty."""
    least = np.full((BANDS, BUCKETS), np.uint64(1 << 63))
    for at in range(0, len(hashes), 1024):
        x = (hashes[None, at : at + 1024] ^ _XOR[:, None]) * _ODD[:, None]
        x ^= x >> np.uint64(29)
        x *= _M1
        x ^= x >> np.uint64(32)
        for k in range(BUCKETS):
            # the two top bits are the bucket: with these turned to 0 for bucket k, the least of all is its own, if it has one
            low = (x ^ np.uint64(k << 62) if k else x).min(axis=1)
            np.minimum(least[:, k], np.where(low >> np.uint64(62) == 0, low, np.uint64(1 << 63)), out=least[:, k])
    return least.reshape(-1)


def compress(least: np.ndarray) -> np.ndarray:
    """16-bit registers: leading zeros of the 62 bits, then the bits behind the first one."""
    m, e = np.frexp((least >> np.uint64(9)).astype(np.float64))
    zeros = np.clip(53 - e, 0, 62)
    root = ((m * 2 - 1).clip(0) * (1 << ROOT_BITS)).astype(np.int64)
    return np.where(least >> np.uint64(63) == 1, EMPTY, zeros << ROOT_BITS | root).astype(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from registers (last axis), without what agrees by accident."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=-1) / np.maximum(1, used.sum(axis=-1))
    return np.clip((same - ACCIDENT) / (1 - ACCIDENT), 0, 1)


def sketch(df: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """df with n_shingles, sig (the set's digest, null if empty) and bands (the registers as one long for each band)."""

    def make():
        shingles = Shingles(words)

        def f(b: pa.RecordBatch) -> list:
            sets = [shingles(t) for t in texts(b, text_col)]
            regs = compress(np.array([registers(s) for s in sets], np.uint64).reshape(-1, BANDS * BUCKETS))
            keys = regs.view("<i8").reshape(-1)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys, pa.int64()))
            return [pa.array([len(s) for s in sets], pa.int64()), [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], bands]

        return f

    return extend(df, [("n_shingles", T.LongType()), ("sig", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))], make)


def _regs(values, n: int) -> np.ndarray:
    return np.asarray(values, dtype="<i8").view("<u2").reshape(n, BANDS * BUCKETS)


def small(t: DataFrame, limit: int | None = None) -> DataFrame:
    """t, broadcast if it has few rows."""
    return F.broadcast(t) if t.count() <= (SMALL_IDS if limit is None else limit) else t


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose estimate reaches CUT, with it."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for b in batches:
            est = similarity(_regs(b.column(2).flatten(), len(b)), _regs(b.column(3).flatten(), len(b)))
            keep = np.flatnonzero(est >= CUT)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(est[keep])], ["a", "b", "est"])

    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long, est double")


def _keyed(classes: DataFrame, *more: str) -> DataFrame:
    """A row for each class and band, with its key and the next band's."""
    rows = F.expr(f"explode(transform(bands, (k, i) -> named_struct('band', i, 'key', k, 'next', bands[(i + 1) % {BANDS}])))")
    return classes.select("node", *more, rows.alias("x")).select("x.band", "x.key", "x.next", "node", *more)


def _neighbours(keyed: DataFrame) -> DataFrame:
    """Distinct pairs of neighbours with equal keys in each band, dealt by key, next key and node so that hot keys are split."""
    order = ["band", "key", "next", "node"]
    dealt = keyed.select(order).repartitionByRange(parts(keyed.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches):
        last = None
        for b in batches:
            band, key, node = (np.asarray(b.column(i)) for i in range(3))
            if last is not None:
                band, key, node = (np.concatenate([[x], y]) for x, y in zip(last, (band, key, node), strict=True))
            if len(node):
                last = band[-1], key[-1], node[-1]
            hit = (band[1:] == band[:-1]) & (key[1:] == key[:-1])
            x, y = node[:-1][hit], node[1:][hit]
            got = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    return dealt.select("band", "key", "node").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, words: int, unique: bool) -> DataFrame:
    """wanted (node, rep, sig and what else) with set, the full sets (sorted 64-bit hashes); rep: the id of a document that has it."""
    keep = [c for c in wanted.columns if c not in ("rep", "sig")]
    chosen = docs.join(small(wanted), docs["doc_id"] == wanted["rep"]).select(*keep, "sig", "text")

    def make():
        shingles = Shingles(words)

        def f(b: pa.RecordBatch) -> list:
            sets = [shingles(t).tobytes() for t in texts(b, "text")]
            return [sets, [xxhash.xxh3_128_digest(x) for x in sets]]

        return f

    # an id may have other texts too
    out = extend(chosen, [("set", T.BinaryType()), ("own", T.BinaryType())], make).where("own = sig").select(*keep, "set")
    return out if unique else out.dropDuplicates(["node"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b. Shingles of one side only are left out."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out

    def places(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        col = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[col] == flat
        return np.repeat(np.arange(len(n)), n)[hit], col[hit]

    (ra, ca), (rb, cb) = places(flat_a, na), places(flat_b, nb)
    for at in range(0, len(both), WIDTH):
        width = min(WIDTH, len(both) - at)
        side = []
        for rows, cols, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            m = np.zeros((n, width), np.float32)
            here = (cols >= at) & (cols < at + width)
            m[rows[here], cols[here] - at] = 1
            side.append(m)
        out += side[0] @ side[1].T
    return out


def _linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    both = intersections(a, b)
    sizes = np.array([len(x) for x in a], np.float64)[:, None] + np.array([len(x) for x in b], np.float64)
    return 100 * both.astype(np.float64) >= percent * (sizes - both)


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Of a symmetric table of links, as many as connect what all of them connect."""
    out, left = [], np.ones(len(links), bool)
    for i in range(len(links)):
        if not left[i]:
            continue
        left[i] = False
        reach = [i]
        for x in reach:
            new = np.flatnonzero(links[x] & left)
            left[new] = False
            out += [(x, int(y)) for y in new]
            reach += new.tolist()
    return out


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """members: cluster, block, node, set. Links that connect a block as all its links would."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node = t["node"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        if len(node) == 2:
            found = [(0, 1)] if linked(*sets, percent) else []
        else:
            found = spanning(_linked(sets, sets, percent))
        return pa.table({"a": pa.array([node[x] for x, _ in found], pa.int64()), "b": pa.array([node[y] for _, y in found], pa.int64())})

    return members.select("cluster", "block", "node", "set").groupBy("cluster", "block").applyInArrow(run, "a long, b long")


def _lone_counts(members: DataFrame) -> DataFrame:
    """node, lone: how many of its shingles no other member of its cluster has, in whatever block. A block sends one row for each
    distinct shingle, with the set that holds it, or with none if two or more of its sets do."""

    def run(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        every, count = np.unique(np.concatenate(sets), return_counts=True)
        once, more = every[count == 1], every[count > 1]
        lone = [x[np.isin(x, once, assume_unique=True)] for x in sets]
        n = [len(x) for x in lone]
        node = pa.concat_arrays([pa.array(np.repeat(t["node"].to_numpy(), n), pa.int64()), pa.nulls(len(more), pa.int64())])
        return pa.table({"cluster": pa.array([t["cluster"][0].as_py()] * len(node), pa.int64()), "shingle": pa.array(np.concatenate([*lone, more]).view(np.int64)), "node": node})

    seen = members.select("cluster", "block", "node", "set").groupBy("cluster", "block").applyInArrow(run, "cluster long, shingle long, node long")
    return seen.groupBy("cluster", "shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1 and node is not null").groupBy("node").agg(F.count("*").alias("lone"))


def _confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; a table) that link, on their full sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = members.select("node", "set").join(small(nodes), "node", "left_semi")
    both = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def run(batches):
        for b in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return cut(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "confirmed")


def _across(members: DataFrame, group: list[str], test, label: str = "comp", data: str = "data") -> DataFrame:
    """Links (a, b) between members of a group with different labels, one for each two labels and two packs at most. members: the group's
    columns, node, label and data (binary). Every member whose label isn't the group's most frequent one is held against all, as
    packs against packs that are dealt over all tasks. test(data of some, data of others) gives a table of who links with whom."""
    by = members.groupBy(*group, label).agg(F.count("*").alias("m"), F.sum(F.length(data)).alias("w"))
    top = by.groupBy(*group).agg(F.max(F.struct("m", "w", label)).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count("*").alias("labels")).where("labels > 1")
    need = lambda m, w: F.ceil(F.greatest(m / BLOCK, w / PACK_BYTES)).cast("int")
    sizes = top.select(*group, F.col(f"top.{label}").alias("top"), need(F.col("m"), F.col("w")).alias("packs"), need(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("asking"))
    sizes = cut(sizes, "packs", slim=True)
    here = members.join(small(sizes), group)
    row = F.struct(F.col("node"), F.col(label).alias("label"), F.col(data).alias("data"))
    held = here.groupBy(*group, F.pmod(F.xxhash64("node"), F.col("packs")).cast("int").alias("pack")).agg(F.collect_list(row).alias("held"))
    asked = here.where(F.col(label) != F.col("top")).groupBy(*group, "packs", F.pmod(F.xxhash64("node", F.lit(1)), F.col("asking")).alias("ask")).agg(F.collect_list(row).alias("asked"))
    asked = asked.select(*group, F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), "asked")

    def run(batches):
        for b in batches:
            found = []
            for x, y in zip(*b.columns, strict=True):
                (na, la, da), (nb, lb, db) = ([x.values.field(i) for i in range(3)] for x in (x, y))
                la, lb = np.asarray(la), np.asarray(lb)
                hits = test(da, db) & (la[:, None] != lb)
                seen = set()
                for i, j in zip(*np.nonzero(hits), strict=True):
                    if (la[i], lb[j]) not in seen:
                        seen.add((la[i], lb[j]))
                        found.append((na[i].as_py(), nb[j].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    out = cut(asked.join(held, [*group, "pack"]).select("asked", "held").mapInArrow(run, "a long, b long"), "across")
    discard(sizes)
    return out


def _with_comp(t: DataFrame, comps: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
    return t.join(comps.select(F.col("node").alias(node), F.col("comp").alias("__c")), node, "left").withColumn(name, F.coalesce("__c", node)).drop("__c")


def _clusters(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """node, comp of the graph of candidates: those in pairs, and those that share a key with a class of another cluster."""
    clusters = components(pairs, "a", "b")
    tagged = cut(_with_comp(classes, clusters), "tagged")
    keyed = _keyed(tagged, "comp").select("band", "key", "node", "comp")
    mixed = cut(keyed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "key"), "mixed", slim=True)
    near = keyed.join(small(mixed), ["band", "key"]).join(tagged.select("node", "n", "bands"), "node")
    # size and registers as bytes
    data = F.concat(*[F.expr(f"unhex(lpad(hex({x}), 16, '0'))") for x in ("n", *(f"bands[{i}]" for i in range(BANDS)))])

    def both(t: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([np.frombuffer(v.as_buffer(), ">i8") for v in t]).astype("<i8")
        return x[:, 0], _regs(np.ascontiguousarray(x[:, 1:]).reshape(-1), len(x))

    def test(a: pa.Array, b: pa.Array) -> np.ndarray:
        (na, ra), (nb, rb) = both(a), both(b)
        out = np.minimum(na[:, None], nb) * 100 >= np.maximum(na[:, None], nb) * percent
        for i in np.flatnonzero(out.any(axis=1)).tolist():
            at = np.flatnonzero(out[i])
            out[i, at] = similarity(ra[i], rb[at]) >= CUT
        return out

    bridges = _across(near.select("band", "key", "node", "comp", data.alias("data")), ["band", "key"], test)
    out = joined(clusters, bridges, "a", "b")
    discard(tagged, mixed, bridges)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: the id, n_shingles, component_id, kept."""
    ready(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(sketch(docs, "text", words).drop("text"), "sketch")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    grouped = known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("node"), "rep", "n", "bands", "sig"), "classes")
    repeated = cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated", slim=True)
    unique = repeated.isEmpty()

    # a smaller set links with none but its equals
    able = classes.where(F.col("n") * (100 - percent) >= percent)
    pairs = cut(_estimated(_neighbours(_keyed(able)), able, percent), "pairs")
    clusters = _clusters(able, pairs, percent)
    clusters = cut(clusters.union(clusters.select(F.col("comp").alias("node"), "comp").distinct()).toDF("node", "cluster"), "clusters", slim=True)
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = clusters.join(sizes, "cluster").select("node", "cluster", "blocks", F.expr("pmod(xxhash64(node), blocks)").alias("block"))
    blocks = cut(blocks.join(classes.select("node", "rep", "sig"), "node"), "blocks", slim=True)
    members = cut(_sets(docs, blocks, words, unique), "members")
    links = cut(_block_links(members, percent), "block_links")
    comps = components(links, "a", "b")

    split = members.where("blocks > 1")
    if not split.isEmpty():
        # between the blocks of a cluster: the best candidate of each two parts
        inside = pairs.join(split.select(F.col("node").alias("a")), "a", "left_semi")
        apart = _with_comp(_with_comp(inside, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb")
        best = cut(apart.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max(F.struct("est", "a", "b")).alias("x")).select("x.a", "x.b"), "best", slim=True)
        sure = _confirmed(best, split, percent)
        comps = joined(comps, sure, "a", "b")
        # and what is still apart, against all of the cluster
        lone = cut(_lone_counts(split), "lone", slim=True)
        able_to = _with_comp(split, comps).join(lone, "node", "left").where(F.expr(f"(length(set) / 8 - coalesce(lone, 0)) * 100 >= length(set) / 8 * {percent}"))
        sets = lambda t: [np.frombuffer(x.as_buffer(), np.uint64) for x in t]
        more = _across(able_to.select("cluster", "node", "comp", F.col("set").alias("data")), ["cluster"], lambda a, b: _linked(sets(a), sets(b), percent))
        comps = joined(comps, more, "a", "b")
        discard(best, sure, lone, more)
    if not unique:
        # the texts of an id are one document
        own = known.join(small(repeated), "doc_id", "left_semi").select("doc_id", "sig").distinct().join(classes.select("sig", "node"), "sig")
        same = cut(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b"), "same", slim=True)
        comps = joined(comps, same, "a", "b")
        discard(same)
    discard(members, links, pairs, clusters, blocks)

    # a component's name is the smallest id in it
    ends = comps.union(comps.select(F.col("comp").alias("node"), "comp").distinct()).join(classes.select("node", "rep"), "node")
    names = ends.groupBy("comp").agg(F.min("rep").alias("name"))
    named = cut(_with_comp(classes.select("sig", "node", "rep"), comps).join(names, "comp", "left").select("sig", F.coalesce("name", "rep").alias("name")), "names", slim=True)
    out = rows.select("doc_id", "n_shingles", "sig").join(named, "sig", "left").withColumn("name", F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id")))
    if not unique:
        of_id = out.join(small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("name").alias("of_id"))
        out = out.join(of_id, "doc_id", "left").withColumn("name", F.coalesce("of_id", "name"))
    kept = F.coalesce(F.col("name") == F.col("doc_id"), F.lit(True))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.col("name").alias("component_id"), kept.alias("kept"))

"""Exact removal of repeated byte strings by a distributed merge of sorted suffixes (operator 10).

Every string of LENGTH bytes that also starts earlier (in a smaller doc_id, or before in the same document) is removed
where it repeats; strings are judged on the input. Not every suffix has to be sorted for that: in each window of LENGTH
bytes the GRAM-byte string of least hash (the first, if several) is its anchor, so equal windows have equal anchors at
equal places, and only suffixes at anchors (about one in 35 bytes) matter.

1. Texts are packed into segments of about SEGMENT bytes, compressed, in a table.
2. Each segment finds its anchors. Windows around an anchor whose whole surroundings came before in the segment are
   removed at once. Hashes of the other anchors' grams go, packed, to their buckets, which answer with those that occur
   more than once.
3. For these, each task sorts the suffixes at its segments' anchors (with what stands before them, backwards, as the end of the sort
   key) and front-codes them: a record holds only what differs from the record before. These runs are exchanged.
4. Each bucket merges its runs with a loser tree that keeps for each run's head the length of the prefix it shares with
   the last output, and compares only beyond it. What comes out with GRAM bytes or more in common shares an anchor, and there
   the windows of the group are compared and all but the first removed.
5. Grams with more than HOT surroundings do not meet in a bucket: their windows are dealt by their own digest, with a grouped
   minimum, so that one very common passage is nobody's burden.
6. Segments gather their removed spans and give the result.

Null texts are empty. Rows that share a doc_id count in the order they are stored in a segment, and by segment; null ids come
before all others. Texts shorter than LENGTH lose nothing; a longer one than
SEGMENT is a segment by itself. Ids are whole numbers (other kinds are cast, or the job fails). Only id and text are read, so other columns don't matter. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts, ready

LENGTH, GRAM = 100, 32
SEGMENT = 2_000_000
#: Bytes of sort keys that a task gathers from its segments before it hands on sorted runs.
RUN = 16_000_000
#: Bytes of text for each bucket of grams, at most.
BUCKET = 64_000_000
#: Surroundings of one gram that meet in one task.
HOT = 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LEAST = -(1 << 63)


# ---- within a segment


def grams(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position, by doubling."""
    h = (x.astype(np.uint64) + np.uint64(1)) * _A
    size = 1
    while size < GRAM:
        h = h[:-size] * _A + (h[size:] ^ (h[size:] >> np.uint64(29))) * _B
        size *= 2
    return (h ^ (h >> np.uint64(31))) * _B


def first_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, where its least value stands first."""
    at, low, size = np.arange(len(h), dtype=np.int32), h, 1

    def step(by: int) -> None:
        nonlocal at, low
        left = low[:-by] <= low[by:]
        at = np.where(left, at[:-by], at[by:])
        low = np.where(left, low[:-by], low[by:])

    while size * 2 <= width:
        step(size)
        size *= 2
    if size < width:
        step(width - size)
    return at


class Anchors:
    """Of a segment: place p, first and last start of the windows it serves, hash of its gram."""

    def __init__(self, blob: bytes, sizes: np.ndarray, step: int = 1 << 20):
        x = np.frombuffer(blob, np.uint8)
        n = len(x)
        ok = np.zeros(n, bool)
        ends = np.cumsum(sizes)
        for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            if e - s >= LENGTH:
                ok[s : e - LENGTH + 1] = True
        got = []
        for start in range(0, max(0, n - LENGTH + 1), step):
            part = x[start : start + step + LENGTH - 1]
            good = np.flatnonzero(ok[start : start + len(part) - LENGTH + 1])
            if not len(good):
                continue
            h = grams(part)
            p = first_least(h, LENGTH - GRAM + 1)[good]
            new = np.flatnonzero((p[1:] != p[:-1]) | (good[1:] != good[:-1] + 1)) + 1
            lo = np.concatenate([[0], new])
            hi = np.concatenate([new, [len(good)]]) - 1
            got.append((p[lo] + np.int64(start), good[lo] + start, good[hi] + start, h[p[lo]]))
        if got:
            self.p, self.lo, self.hi, self.gram = (np.concatenate(c) for c in zip(*got, strict=True))
            whole = (self.p[1:] == self.p[:-1]) & (self.lo[1:] == self.hi[:-1] + 1)  # cut between two steps
            a, b = np.concatenate([[True], ~whole]), np.concatenate([~whole, [True]])
            self.p, self.lo, self.gram, self.hi = self.p[a], self.lo[a], self.gram[a], self.hi[b]
        else:
            self.p, self.lo, self.hi, self.gram = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
        self.blob = blob
        # of equal surroundings in this segment the first stays
        _, to, count = np.unique(self.gram, return_inverse=True, return_counts=True)
        first, again = set(), np.zeros(len(self.p), bool)
        for i in np.flatnonzero(count[to] > 1).tolist():
            lo = int(self.lo[i])
            key = (int(self.p[i]) - lo, xxhash.xxh3_128_intdigest(blob[lo : int(self.hi[i]) + LENGTH]))
            if key in first:
                again[i] = True
            else:
                first.add(key)
        self.repeats = np.stack([self.lo[again], self.hi[again] + LENGTH], 1)
        for k in ("p", "lo", "hi", "gram"):
            setattr(self, k, getattr(self, k)[~again])


def packed(*arrays: np.ndarray) -> bytes:
    raw = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<4sQ", a.dtype.str.encode(), a.nbytes) for a in arrays) + b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    (n,) = struct.unpack_from("<I", raw)
    heads = [struct.unpack_from("<4sQ", raw, 4 + 12 * i) for i in range(n)]
    out, at = [], 4 + 12 * n
    for kind, size in heads:
        d = np.dtype(kind.rstrip(b"\0").decode())
        out.append(np.frombuffer(raw, d, size // d.itemsize, at))
        at += size
    return out


def sort_key(blob: bytes, p: int, lo: int, hi: int) -> bytes:
    """The suffix as far as the anchor's windows reach, filled up, and then what stands before it, backwards."""
    return blob[p : hi + LENGTH].ljust(LENGTH, b"\0") + blob[lo:p][::-1]


def front_coded(keys: list[bytes], p: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, seg: np.ndarray) -> bytes:
    """A sorted run. before, after: how many bytes before its anchor a record's first and last window start."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    width = max(map(len, keys))
    m = np.frombuffer(b"".join(keys[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(keys), width)
    size = np.array([len(keys[i]) for i in order], np.uint8)
    differ = np.concatenate([m[1:] != m[:-1], np.ones((len(m) - 1, 1), bool)], 1)
    shared = np.concatenate([[0], np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1]))]).astype(np.uint8)
    rest = b"".join(keys[i][s:] for i, s in zip(order, shared.tolist(), strict=True))
    return packed(shared, size, before[order].astype(np.uint8), after[order].astype(np.uint8), p[order].astype(np.int64), doc[order].astype(np.int64), seg[order].astype(np.int64), np.frombuffer(rest, np.uint8))


# ---- merging runs


def run_of(raw: bytes):
    """Yields (shared prefix with the record before, key, record) of a run."""
    shared, size, before, after, p, doc, seg, rest = unpacked(raw)
    rest, at, key = rest.tobytes(), 0, b""
    for s, n, b, a, x, d, g in zip(*(c.tolist() for c in (shared, size, before, after, p, doc, seg)), strict=True):
        key = key[:s] + rest[at : at + n - s]
        at += n - s
        yield s, key, (d, g, x, b, a)


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, which agree in the first `known` bytes."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (diff.bit_length() + 7) // 8


def merged(runs: list):
    """A loser tree over runs: yields (prefix shared with the output before, key, record) in the order of keys."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    keys = [h[1] if h else None for h in heads]
    known = [0] * k  # of each head, the prefix it shares with the last output

    def beats(i: int, j: int) -> bool:
        a, b = keys[i], keys[j]
        if a is None or b is None:
            return b is None
        if known[i] != known[j]:
            return known[i] > known[j]
        h = shared_prefix(a, b, known[i])
        i_first = len(a) <= len(b) if h == min(len(a), len(b)) else a[h] < b[h]
        known[j if i_first else i] = h
        return i_first

    size = 1
    while size < k:
        size *= 2
    keys += [None] * (size - k)
    known += [0] * (size - k)
    lost = [0] * size
    best = [0] * (2 * size)
    for i in range(size):
        best[size + i] = i
    for node in range(size - 1, 0, -1):
        i, j = best[2 * node], best[2 * node + 1]
        best[node], lost[node] = (i, j) if beats(i, j) else (j, i)
    w = best[1]
    while keys[w] is not None:
        yield known[w], keys[w], heads[w][2]
        h = heads[w] = next(runs[w], None)
        keys[w], known[w] = (h[1], h[0]) if h else (None, 0)
        node = (size + w) // 2
        while node:
            if not beats(w, lost[node]):
                w, lost[node] = lost[node], w
            node //= 2


def resolve(group: list[tuple[bytes, tuple]], found: dict[int, list]) -> None:
    """Adds the spans of the windows that came before in the group, by segment."""
    seen: set = set()
    whole: set = set()
    for key, (_, seg, p, before, after) in sorted(group, key=lambda x: x[1][:3]):
        full = (key, before, after)
        if full in whole:
            found.setdefault(seg, []).append((p - before, p - after + LENGTH))
            continue
        whole.add(full)
        text = key[LENGTH:][::-1] + key[: LENGTH - after]
        start = None
        for i in range(before - after + 1):
            w = text[i : i + LENGTH]
            if w in seen:
                if start is None:
                    start = i
            else:
                seen.add(w)
                if start is not None:
                    found.setdefault(seg, []).append((p - before + start, p - before + i - 1 + LENGTH))
                    start = None
        if start is not None:
            found.setdefault(seg, []).append((p - before + start, p - after + LENGTH))


# ---- the tables


def segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        rows, size = [], 0

        def row():
            nonlocal rows, size, n
            rows.sort(key=lambda r: _LEAST if r[0] is None else r[0])
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[len(r[1]) for r in rows]], pa.list_(pa.int64())), pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(r[1] for r in rows))], pa.binary())],
                ["seg", "ids", "sizes", "blob"],
            )
            rows, size, n = [], 0, n + 1
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                raw = t.as_py() or b""
                if rows and size + len(raw) > SEGMENT:
                    yield row()
                rows.append((i, raw))
                size += len(raw)
        if rows:
            yield row()

    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return cut(base.mapInArrow(run, "seg long, ids array<long>, sizes array<long>, blob binary"), "segments")


def _each(b: pa.RecordBatch):
    for i in range(b.num_rows):
        yield {k: b.column(j)[i] for j, k in enumerate(b.schema.names)}


def _text(row: dict) -> bytes:
    return zstandard.ZstdDecompressor().decompress(row["blob"].as_py())


def _anchors(row: dict) -> Anchors:
    return Anchors(_text(row), row["sizes"].values.to_numpy(zero_copy_only=False))


def _asked(segs: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """For each segment the grams that occur more than once anywhere (often: and those that are hot)."""

    def ask(batches):
        for b in batches:
            for row in _each(b):
                a = _anchors(row)
                gram, count = np.unique(a.gram, return_counts=True)
                to = (gram % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order])) + 1
                groups = [g for g in np.split(order, cuts) if len(g)]
                data = [packed(gram[g], count[g].astype(np.uint32)) for g in groups]
                yield pa.RecordBatch.from_arrays([pa.array([int(to[g[0]]) for g in groups], pa.int32()), pa.array([row["seg"].as_py()] * len(groups), pa.int64()), pa.array(data, pa.binary())], ["bucket", "seg", "data"])

    def answer(t: pa.Table) -> pa.Table:
        seg, data = t["seg"].to_pylist(), [unpacked(x.as_py()) for x in t["data"]]
        gram, to = np.unique(np.concatenate([g for g, _ in data]), return_inverse=True)
        total = np.bincount(to.ravel(), np.concatenate([c for _, c in data]))
        out, at = [], 0
        for g, _ in data:
            n = total[to.ravel()[at : at + len(g)]]
            at += len(g)
            out.append(packed(g[n > 1], g[n > hot]) if (n > 1).any() else None)
        keep = [i for i, x in enumerate(out) if x]
        return pa.table({"seg": pa.array([seg[i] for i in keep], pa.int64()), "data": pa.array([out[i] for i in keep], pa.binary())})

    return segs.mapInArrow(ask, "bucket int, seg long, data binary").groupBy("bucket").applyInArrow(answer, "seg long, data binary")


def _runs(segs: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """kind 0: a segment's own repeats. 1: a bucket's run. 2: a window of a hot gram, by its digest."""
    names = ["kind", "bucket", "seg", "doc", "start", "data"]

    def run(batches):
        gathered, size = [], 0

        def table(rows):
            for at in range(0, len(rows), 20_000):
                part = list(zip(*rows[at : at + 20_000], strict=True))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names)

        def sorted_runs():
            keys = [k for g in gathered for k in g[0]]
            to, p, before, after, doc, seg = (np.concatenate([g[i] for g in gathered]) for i in range(1, 7))
            order = np.argsort(to, kind="stable")
            rows = []
            for g in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                rows.append((1, int(to[g[0]]), None, None, None, front_coded([keys[i] for i in g], p[g], before[g], after[g], doc[g], seg[g])))
            return rows

        for b in batches:
            for row in _each(b):
                seg, a = row["seg"].as_py(), _anchors(row)
                ids = np.array([_LEAST if i is None else i for i in row["ids"].as_py()], np.int64)
                ends = np.cumsum(row["sizes"].values.to_numpy(zero_copy_only=False))
                if len(a.repeats):
                    yield from table([(0, None, seg, None, None, packed(a.repeats))])
                lists = [unpacked(x) for x in row["lists"].as_py() or []]
                if not lists:
                    continue
                often = np.isin(a.gram, np.concatenate([x for x, _ in lists]))
                hot = np.isin(a.gram, np.concatenate([x for _, x in lists]))
                doc = ids[np.searchsorted(ends, a.p, side="right")]
                for i in np.flatnonzero(hot).tolist():
                    yield from table([(2, None, seg, int(doc[i]), s, xxhash.xxh3_128_digest(a.blob[s : s + LENGTH])) for s in range(int(a.lo[i]), int(a.hi[i]) + 1)])
                k = np.flatnonzero(often & ~hot)
                if len(k):
                    keys = [sort_key(a.blob, p, lo, hi) for p, lo, hi in zip(a.p[k].tolist(), a.lo[k].tolist(), a.hi[k].tolist(), strict=True)]
                    gathered.append((keys, (a.gram[k] % np.uint64(buckets)).astype(np.int64), a.p[k], a.p[k] - a.lo[k], a.p[k] - a.hi[k], doc[k], np.full(len(k), seg)))
                    size += sum(map(len, keys))
                    if size > RUN:
                        yield from table(sorted_runs())
                        gathered, size = [], 0
        if gathered:
            yield from table(sorted_runs())

    # a list from each bucket that has something of the segment
    lists = asked.groupBy("seg").agg(F.collect_list("data").alias("lists"))
    return cut(segs.join(lists, "seg", "left").mapInArrow(run, "kind int, bucket int, seg long, doc long, start long, data binary"), "runs")


def _found(runs: DataFrame) -> DataFrame:
    """seg, data: spans that the merge removes."""

    def merge(t: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        group: list = []
        for known, key, rec in merged([run_of(x.as_py()) for x in t["data"]]):
            if known < GRAM:
                if len(group) > 1:
                    resolve(group, found)
                group = []
            group.append((key, rec))
        if len(group) > 1:
            resolve(group, found)
        return pa.table({"seg": pa.array(list(found), pa.int64()), "data": pa.array([packed(np.array(x, np.int64).reshape(-1, 2)) for x in found.values()], pa.binary())})

    return runs.where("kind = 1").select("bucket", "data").groupBy("bucket").applyInArrow(merge, "seg long, data binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (removed runs), kept_sha256, and kept, the bytes that stay."""
    spark = ready(docs.sparkSession)
    segs = segments(docs, id_col, text_col)
    # what a bucket's grams and runs take follows from the input, whatever the number of partitions
    buckets = max(parts(spark), -(-segs.count() * SEGMENT // BUCKET))
    runs = _runs(segs, _asked(segs, buckets, hot), buckets)
    windows = runs.where("kind = 2").select("data", "doc", "seg", "start")
    own = windows.groupBy("data").agg(F.min(F.struct("doc", "seg", "start")).alias("first"))
    late = windows.join(own, "data").where("struct(doc, seg, start) > first").groupBy("seg").agg(F.collect_list("start").alias("starts"))
    spans = runs.where("kind = 0").select("seg", "data").union(_found(runs)).groupBy("seg").agg(F.collect_list("data").alias("spans"))
    both = segs.join(spans, "seg", "left").join(late, "seg", "left")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])]

    def run(batches):
        for b in batches:
            for row in _each(b):
                x = np.frombuffer(_text(row), np.uint8)
                change = np.zeros(len(x) + 1, np.int32)
                for raw in row["spans"].as_py() or []:
                    s = unpacked(raw)[0].reshape(-1, 2)
                    np.add.at(change, s[:, 0], 1)
                    np.add.at(change, s[:, 1], -1)
                starts = np.array(row["starts"].as_py() or [], np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                out, at = [], 0
                for i, n in zip(row["ids"].as_py(), row["sizes"].as_py(), strict=True):
                    g = gone[at : at + n]
                    kept = x[at : at + n][~g].tobytes()
                    at += n
                    runs = int(np.count_nonzero(g[1:] & ~g[:-1])) + bool(n and g[0])
                    out.append((i, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.string(), pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names)

    return both.select("ids", "sizes", "blob", "spans", "starts").mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)

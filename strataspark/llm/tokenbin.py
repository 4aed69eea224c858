"""Token ids in one compressed wavelet-matrix file per shard (operator 6).

Documents are dealt by ranges of doc_id (and of a hash of the text, so that one id that many rows share is no burden), and
each task writes its range as one or more shards. A shard file holds the bit planes of all its ids from the highest bit
down (each plane keeps the order of the one above, zeros before ones), the ones before every BLOCK bits as rank samples, and
the documents' boundaries. Planes are compressed in chunks of CHUNK bits, so that `WaveletMatrix` answers access to a
position, counts of an id before a position (rank) and the place of its k-th occurrence (select) from the chunks that
these touch. `all` undoes whole planes instead, which is faster for a reader of every document.

Files are rows of a table in the folder that all executors share, so that lost executors and remote stores are no
concern. Null and empty texts hold the end id only. Rows with the same doc_id are all kept, side by side. Null doc_ids
come first. A text of any length is one document of one shard; ids are whole numbers (other kinds are cast, or the job fails). An
empty table gives no shard and no row. Only id and text are read, so other columns don't matter.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_spec
from .common import column, cut, gathered, parts, ready, tokenizer_path
from .merging import merger

FILE = "word_bpe_49k.json"
END_ID = 1
#: Tokens of a shard, at most one document more. A task's range is written as several shards beyond that.
SHARD_TOKENS = 1_000_000
#: Bytes of texts that are encoded at once, and chunks in a worker's memo (some 60 bytes each).
GATHER, MEMO = 12_000_000, 400_000
#: Shards up to which the table of their sums (20 bytes each) is broadcast; beyond that it is joined by a shuffle.
SMALL_SHARDS = 500_000
BLOCK, CHUNK = 512, 1 << 18  # bits between rank samples, bits compressed at once
MAGIC = b"WAVM0002"


class WaveletMatrix:
    """Over the bytes of a file. Layout: magic, counts of ids, planes and documents; zeros of each plane; sizes of all compressed
    pieces; then these: each plane's samples and chunks, and at last the documents' boundaries."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        self.raw = raw
        self.n, self.bits, n_docs = struct.unpack_from("<QII", raw, 8)
        self.zeros = list(struct.unpack_from(f"<{self.bits}Q", raw, 24))
        self.chunks = -(-self.n // CHUNK)
        pieces = self.bits * (1 + self.chunks) + 1
        at = 24 + 8 * self.bits
        self.at = at + 4 * pieces + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", pieces, at), dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()
        self.held: dict[int, np.ndarray] = {}
        self.docs = self._piece(pieces - 1, "<i8")
        if len(self.docs) != n_docs:
            raise ValueError("a token file whose boundaries are damaged")

    @classmethod
    def build(cls, ids: np.ndarray, doc_starts: np.ndarray) -> WaveletMatrix:
        """ids: unsigned."""
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        z = zstandard.ZstdCompressor(level=1)
        zeros, body, now = [], [], ids
        for level in range(bits - 1, -1, -1):
            one = (now >> level) & 1 == 1
            plane = np.packbits(one, bitorder="little")
            ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint16) if len(plane) else np.zeros(0, np.uint16)
            body += [z.compress(ones.tobytes()), *(z.compress(plane[i : i + CHUNK // 8].tobytes()) for i in range(0, len(plane), CHUNK // 8))]
            up, down = np.flatnonzero(one), np.flatnonzero(~one)
            zeros.append(len(down))
            now = np.concatenate([now[down], now[up]])
        docs = np.asarray(doc_starts, "<i8")
        body.append(z.compress(docs.tobytes()))
        head = MAGIC + struct.pack("<QII", len(ids), bits, len(docs)) + struct.pack(f"<{bits}Q", *zeros) + struct.pack(f"<{len(body)}I", *map(len, body))
        return cls(head + b"".join(body))

    def to_bytes(self) -> bytes:
        return self.raw

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        return cls(raw)

    def _piece(self, k: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.zstd.decompress(self.raw[self.at[k] : self.at[k + 1]]), kind)

    def _chunk(self, level: int, c: int) -> np.ndarray:
        k = level * (1 + self.chunks) + 1 + c
        if k not in self.held:
            self.held[k] = self._piece(k, "u1")
        return self.held[k]

    def _samples(self, level: int) -> np.ndarray:
        """Ones before each block of a plane, and at its end."""
        k = level * (1 + self.chunks)
        if k not in self.held:
            self.held[k] = np.concatenate([[0], np.cumsum(self._piece(k, "<u2"), dtype=np.int64)])
        return self.held[k]

    def _plane(self, level: int) -> np.ndarray:
        """All bytes of a plane; they are not kept."""
        return np.concatenate([np.zeros(0, np.uint8), *(self._piece(level * (1 + self.chunks) + 1 + c, "u1") for c in range(self.chunks))])

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // BLOCK
        rest = i - block * BLOCK
        ones = int(self._samples(level)[block])
        if rest:
            begin = block * BLOCK % CHUNK // 8
            cell = self._chunk(level, i // CHUNK)[begin : begin + (rest + 7) // 8]
            ones += int(np.bitwise_count(cell[: rest // 8]).sum())
            if rest % 8:
                ones += int(cell[rest // 8] & ((1 << rest % 8) - 1)).bit_count()
        return ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = int(self._chunk(level, i // CHUNK)[i % CHUNK // 8]) >> i % 8 & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def document(self, k: int) -> list[int]:
        """The ids of the k-th document, by access."""
        return [self.access(i) for i in range(int(self.docs[k]), int(self.docs[k + 1]))]

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before position i."""
        return self._narrow(value, i)[1]

    def _narrow(self, value: int, i: int) -> tuple[int, int]:
        """Where the run of value begins below the last plane, and its occurrences before i."""
        if value < 0 or value >> self.bits:
            return 0, 0
        lo = 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, i)
            if value >> (self.bits - 1 - level) & 1:
                lo, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, i = lo - a, i - b
        return lo, max(0, i - lo)

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of value, -1 if there are fewer."""
        lo, found = self._narrow(value, self.n)
        if k < 0 or k >= found:
            return -1
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        ones = self._samples(level)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        begin = block * BLOCK % CHUNK // 8
        cell = np.unpackbits(self._chunk(level, block * BLOCK // CHUNK)[begin : begin + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(cell == bit)[k - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def all(self) -> np.ndarray:
        """Every id in order: from the last plane up, each plane's order is undone and its bit put in."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self._plane(level), count=self.n, bitorder="little").view(bool)
            zeros, up = self.zeros[level], np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[:zeros]
            up[np.flatnonzero(bit)] = out[zeros:] | out.dtype.type(1 << (self.bits - 1 - level))
            out = up
        return out


def write_shards(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of shards: part and shard (their order is that of doc_id), n_tokens, doc_ids, file."""
    spark = ready(df.sparkSession)
    shared = spark.sparkContext.broadcast(spec)
    names, kinds = ["part", "shard", "n_tokens", "doc_ids", "file"], [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        from pyspark import TaskContext

        m = merger(shared.value, memo=MEMO)
        part, shard = TaskContext.get().partitionId(), 0
        ids, sizes, docs, size = [], [], [], 0

        def done():
            nonlocal ids, sizes, docs, size, shard
            flat = np.concatenate(ids)
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            file = WaveletMatrix.build(flat.astype(np.uint16) if flat.max() < 65536 else flat.astype(np.uint32), starts).to_bytes()
            row = [part, shard, len(flat), pa.concat_arrays(docs).to_pylist(), file]
            ids, sizes, docs, size, shard = [], [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for b in gathered(batches, GATHER):
            got = m.encode_column(column(b, text_col))
            if not len(got):
                continue
            ends = np.asarray(got.offsets).astype(np.int64)
            n = np.diff(ends) + 1
            ends = ends[1:] + np.arange(len(n))  # where each document's end id comes
            flat = np.full(ends[-1] + 1, end_id, np.int32)
            own = np.ones(len(flat), bool)
            own[ends] = False
            flat[own] = np.asarray(got.values)
            of, at = column(b, id_col).cast(pa.int64()), 0
            while at < len(n):  # documents up to the one that fills the shard
                filled = np.searchsorted(np.cumsum(n[at:]), shard_tokens - size) + 1
                to = min(len(n), at + int(filled))
                ids.append(flat[ends[at] - n[at] + 1 : ends[to - 1] + 1])
                sizes.append(n[at:to])
                docs.append(of.slice(at, to - at))
                size, at = size + len(ids[-1]), to
                if size >= shard_tokens:
                    yield done()
        if docs:
            yield done()

    order = [F.col(id_col), F.xxhash64(text_col)]
    dealt = df.select(id_col, text_col).repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    return cut(dealt.mapInArrow(run, "part int, shard int, n_tokens long, doc_ids array<long>, file binary"), "tokens")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row for each document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    sizes = shards.select("part", "shard", "n_tokens")

    def before(*order: str):
        return F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # sums in two levels: over parts (as many rows as tasks), and within each
    of_parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before("part").alias("ahead"))
    base = sizes.select("part", "shard", before("part", "shard").alias("base")).join(F.broadcast(of_parts), "part").select("part", "shard", (F.col("base") + F.col("ahead")).alias("base"))

    def run(batches):
        for b in batches:
            for base, doc_ids, file in zip(*b.columns, strict=True):
                w = WaveletMatrix.from_bytes(file.as_py())
                ids, at = w.all().astype("<u4"), w.docs
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(at[:-1] + base.as_py()), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if sizes.count() <= SMALL_SHARDS:
        base = F.broadcast(base)
    return shards.join(base, ["part", "shard"]).select("base", "doc_ids", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    return read_shards(write_shards(df, read_spec(path or tokenizer_path(FILE)), id_col, text_col))

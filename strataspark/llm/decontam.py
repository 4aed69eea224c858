"""Benchmark decontamination by pigeonhole edit matching (operator 1).

Texts are compared as their words in lower case, without signs. An item of w words may appear with up to
min(floor(ERRORS * w), floor(w / PIECE_WORDS) - 1) words put in, left out or changed (none, if it is shorter than that
allows). Split into one piece more than that, it must appear with one piece unchanged: an automaton finds all exact
piece hits in a pass over the texts, and around each hit Myers' bit-parallel recurrence, over words, gives the least
distance and where it ends; run backwards from there it gives where the match starts.

The items are taken in blocks of at most BLOCK_BYTES, each one pass over the texts, so that what is broadcast is bounded.
Null texts and items, and items without words, match nothing. An item of any length counts, also one of a single word, which then
matches every text that holds that word. Repeated items match each under its own id, repeated documents each for itself; of an
item's matches that overlap the nearest counts, and of equally near ones the first. Texts of any length are searched whole, one
at a time. A table without rows on either side gives an empty result, or leaves the documents as they are. Further columns are
kept, and what they are called doesn't matter.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, ready, texts

ERRORS = 0.15
PIECE_WORDS = 3
BLOCK_BYTES = 8_000_000
WORD = re.compile(r"\w+")


def budget(words: int, errors: float = ERRORS) -> int:
    return max(0, min(int(errors * words), words // PIECE_WORDS - 1))


def distances(pattern: list[str], text: list[str]) -> list[int]:
    """For each word of text, the least edit distance between pattern and a stretch that ends there (Myers, 1999)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    up, down, score, out = full, 0, m, []
    for w in text:
        eq = at.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up) & full, up & x
        score += bool(plus & top) - bool(minus & top)
        # a match may start anywhere in the text: the row above costs nothing
        plus, minus = plus << 1 & full, minus << 1 & full
        v = eq | down
        up, down = minus | ~(v | plus) & full, plus & v
        out.append(score)
    return out


class Matcher:
    """items: (id, text)."""

    def __init__(self, items: list[tuple[int, str | None]], errors: float = ERRORS):
        self.items, pieces = [], {}
        for i, text in items:
            words = WORD.findall((text or "").lower())
            if words:
                k = budget(len(words), errors)
                n = len(self.items)
                self.items.append((i, words, k))
                cuts = [len(words) * j // (k + 1) for j in range(k + 2)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((n, a))
        self.find = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.find.add_word(p, (len(p), where))
        if pieces:
            self.find.make_automaton()
        else:
            self.find = None

    def __call__(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance) of the matches in a text, in code points; of those of one item that overlap,
        the nearest and then the first."""
        if self.find is None or not text:
            return []
        low = text.lower()
        norm = f" {' '.join(WORD.findall(low))} "
        hits = list(self.find.iter(norm))
        if not hits:
            return []
        words = norm.split()
        begins, at = [], 1
        for w in words:
            begins.append(at)
            at += len(w) + 1
        found: dict[int, list[tuple[int, int, int]]] = {}
        tried = set()
        for end, (size, where) in hits:
            p = bisect_right(begins, end - size + 2) - 1
            for n, offset in where:
                _, item, k = self.items[n]
                if (n, p - offset) in tried:
                    continue
                tried.add((n, p - offset))
                lo = max(0, p - offset - k)
                window = words[lo : p - offset + len(item) + k]
                ds = distances(item, window)
                d = min(ds)
                if d > k:
                    continue
                e = ds.index(d)
                back = distances(item[::-1], window[e::-1])
                s = e - back.index(d)
                found.setdefault(n, []).append((d, lo + s, lo + e + 1))
                if first_only:
                    return [(self.items[n][0], 0, 0, d)]
        spans = [(m.start(), m.end()) for m in WORD.finditer(text if len(low) == len(text) else low)]
        out = []
        for n, got in found.items():
            kept: list[tuple[int, int, int]] = []
            for d, s, e in sorted(got):
                if all(e <= a or s >= b for _, a, b in kept):
                    kept.append((d, s, e))
            out += [(self.items[n][0], spans[s][0], spans[e - 1][1], d) for d, s, e in kept]
        return sorted(out, key=lambda x: (x[1], x[2], str(x[0])))


def blocks(bench: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The items in tables of about BLOCK_BYTES each."""
    b = bench.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    size = b.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    return [b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def _passes(spark, bench: DataFrame, item_col: str, text_col: str, one_pass) -> list[DataFrame]:
    """one_pass(broadcast items, result of the pass before) for each block. Of several blocks each pass is written before the next block is gathered, and its items are
    given up then, so that one block at a time is on the driver and the executors."""
    out, parts = [], blocks(bench, item_col, text_col)
    for items in parts:
        shared = spark.sparkContext.broadcast(sorted(((r.i, r.t) for r in items.collect()), key=str))
        got = one_pass(shared, out[-1] if out else None)
        if len(parts) > 1:
            got = cut(got, "decontam")
            shared.unpersist()
        out.append(got)
    return out


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", errors: float = ERRORS) -> DataFrame:
    """One row for each match: the document, the item, where it stands in the text (code points) and its distance in words."""
    spark = ready(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = bench.schema[item_col].dataType
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id {kind.simpleString()}, match_start int, match_end int, distance int"
    names = [id_col, "item_id", "match_start", "match_end", "distance"]

    def one_pass(shared, _):
        def run(batches):
            m = Matcher(shared.value, errors)
            for b in batches:
                rows = [(i, hit) for i, t in enumerate(texts(b, "__text")) for hit in m(t)]
                ids = b.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
                cols = [pa.array([h[j] for _, h in rows], to_arrow_type(kind) if j == 0 else pa.int32()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([ids, *cols], names)

        return base.mapInArrow(run, schema)

    found = _passes(spark, bench, item_col, item_text_col, one_pass)
    return functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", errors: float = ERRORS) -> DataFrame:
    """The documents that hold no item, all columns as they were."""

    def one_pass(shared, left):
        left = docs if left is None else left

        def run(batches):
            m = Matcher(shared.value, errors)
            for b in batches:
                yield b.filter(pa.array([not m(t, first_only=True) for t in texts(b, text_col)], pa.bool_()))

        return left.mapInArrow(run, docs.schema)

    # each pass is over what the one before has left
    kept = _passes(ready(docs.sparkSession), bench, item_col, item_text_col, one_pass)
    return kept[-1] if kept else docs

"""A factorisation machine that scores texts for quality (operator 9).

Features: hashed words (weighted by counts), structure statistics of the text in steps, and its length as metadata. A
text's score is sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise interactions in
time linear in the features.

Fitted on at most TRAIN_ROWS labelled rows, those of the smallest hash of doc_id; their sparse features are what the
driver gathers (12 bytes a distinct word). The model has a fixed size, 2**BITS * (1 + RANK) numbers. Every row is scored.

Texts of any length are read whole; a training row is at most its distinct words (the driver gathers TRAIN_ROWS of them).

Null and empty texts have the features of an empty text and get a score. Rows that share a doc_id with several labels
count with the smallest. Null labels are left out. With no label at all, or one class only, nothing is known to be bad
and every score is 1.0, or the share of label 1. Clashing columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_rest, extend, ready, texts

BITS = 16
RANK = 8
TRAIN_ROWS = 8_000
EPOCHS = 8
THRESHOLD = 0.7
STEPS = 12  # of each statistic
FOLDS, HELD_OUT = 4, 2
_SIGNS = np.zeros(256, np.int64)  # kinds of ASCII bytes: 1 upper case, 2 digit, 3 sign, 4 white space
_SIGNS[65:91] = 1
_SIGNS[48:58] = 2
_SIGNS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_SIGNS[[9, 10, 11, 12, 13, 32]] = 4


class Features:
    """Sparse features of texts; words' slots are kept in a bounded memo."""

    def __init__(self, bits: int = BITS):
        self.size = 1 << bits
        self.slots: dict[str, int] = {}

    def slot(self, name: str) -> int:
        return xxhash.xxh3_64_intdigest(name) % self.size

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        n = len(words)
        counts = Counter(words)
        slots = self.slots
        if len(slots) > 200_000:
            slots.clear()
        for w in [w for w in counts if w not in slots]:
            slots[w] = xxhash.xxh3_64_intdigest("w:" + w.lower().strip(".,;:")) % self.size
        idx = np.fromiter(map(slots.__getitem__, counts), np.int64, len(counts))
        val = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        if n:
            val /= np.sqrt((val * val).sum())
        kinds = np.bincount(_SIGNS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=5)
        size = max(1, int(kinds.sum()))
        letters = max(1, size - int(kinds[2:].sum()))
        lines = text.split("\n")
        ends = Counter(w[-1] for w in words)
        stats = {
            "upper": kinds[1] / letters, "digit": kinds[2] / size, "sign": kinds[3] / size, "space": kinds[4] / size,
            "kinds_of_words": len(counts) / max(1, n), "top_word": max(counts.values(), default=0) / max(1, n),
            "repeat": sum(map(eq, words, words[1:])) / max(1, n), "word_size": min(1.0, len(text) / max(1, n) / 24),
            "same_lines": 1 - len(set(lines)) / len(lines), "line_size": min(1.0, math.log2(1 + len(text) / len(lines)) / 16),
            "bar": text.count("|") / max(1, n), "shout": text.count("!!") / max(1, n),
            "odd_end": sum(c for s, c in ends.items() if not s.isalnum() and s not in ".,;:!?)\"'") / max(1, n), "plain_end": sum(c for s, c in ends.items() if s in ".,;:") / max(1, n),
            "length": min(1.0, math.log2(1 + len(text)) / 20),
        }
        more = [self.slot(f"s:{k}:{min(STEPS, math.ceil(STEPS * v ** 0.5))}") for k, v in stats.items()]
        return np.concatenate([idx, np.array(more, np.int64)]), np.concatenate([val, np.full(len(more), 0.5)])


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's sum before the sigmoid, and its sums by factor. A row has one feature at least."""
        x = self.v[idx] * val[:, None]
        s = np.add.reduceat(x, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((x * x).sum(1), starts)), s

    def score(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, val, starts)[0], -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> Machine:
        """Logistic loss, both classes of equal weight, adaptive steps; the same rows in the same order give the same machine."""
        rng = np.random.default_rng(seed)
        size = 1 << bits
        m = cls(0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)))
        gw, gv = np.full(size, 1e-6), np.full((size, rank), 1e-6)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        m.w0 = math.log(share / (1 - share))
        weight = np.where(labels == 1, min(1.0, 0.5 / share), min(4.0, 0.5 / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                idx = np.concatenate([rows[i][0] for i in part])
                val = np.concatenate([rows[i][1] for i in part])
                n = np.array([len(rows[i][0]) for i in part])
                starts = np.cumsum(n) - n
                y, s = m.raw(idx, val, starts)
                g = np.repeat((1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]) * weight[part], n)
                uniq, to = np.unique(idx, return_inverse=True)
                dw = np.bincount(to, g * val, len(uniq)) + l2 * m.w[uniq]
                each = (g * val)[:, None] * (np.repeat(s, n, axis=0) - m.v[idx] * val[:, None])
                dv = np.zeros((len(uniq), rank))
                np.add.at(dv, to, each)
                dv += l2 * m.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                m.v[uniq] -= rate * 0.5 * dv / np.sqrt(gv[uniq])
        return m


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS):
    """A Machine, or a plain number where labels show one class only."""
    named = labels.where(F.col(id_col).isNotNull() & (crc_rest(id_col, FOLDS) != HELD_OUT)).groupBy(id_col).agg(F.min(label_col).alias("__y")).where("__y is not null")
    named = named.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    fields = [("__i", T.ArrayType(T.IntegerType())), ("__v", T.ArrayType(T.FloatType()))]
    # at most `rows` ids, so the broadcast is bounded
    chosen = docs.select(id_col, text_col).join(F.broadcast(named), id_col)

    def make():
        f = Features()

        def run(b: pa.RecordBatch) -> list:
            got = [f(t) for t in texts(b, text_col)]
            return [[x.astype(np.int32) for x, _ in got], [x.astype(np.float32) for _, x in got]]

        return run

    got = extend(chosen, fields, make).select(id_col, "__y", "__i", "__v").toArrow().sort_by(id_col)
    y = np.array(got["__y"].to_pylist(), np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    xs = [(np.asarray(i.values).astype(np.int64), np.asarray(v.values).astype(np.float64)) for i, v in zip(got["__i"], got["__v"], strict=True)]
    # rows of equal ids may come in any order; the machine must not depend on it
    keys = sorted(range(len(xs)), key=lambda k: (got[id_col][k].as_py(), xs[k][0].tobytes()))
    m = Machine.fit([xs[k] for k in keys], y[keys])
    return Machine(m.w0, m.w.astype(np.float32), m.v.astype(np.float32))


def score(df: DataFrame, model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df with each whole text's score, 0 to 1."""
    shared = ready(df.sparkSession).sparkContext.broadcast(model)

    def make():
        f, m = Features(), shared.value

        def run(b: pa.RecordBatch) -> list:
            if not isinstance(m, Machine):
                return [[m] * b.num_rows]
            if not b.num_rows:
                return [[]]
            got = [f(t) for t in texts(b, text_col)]
            n = np.array([len(i) for i, _ in got])
            return [pa.array(m.score(np.concatenate([i for i, _ in got]), np.concatenate([v for _, v in got]), np.cumsum(n) - n), pa.float64())]

        return run

    return extend(df, [(out_col, T.DoubleType())], make)

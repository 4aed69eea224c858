"""A minimal acyclic transducer from words to token ids.

Words that end alike share states (the automaton is built from sorted words, and a finished state is replaced by an
equal one that exists). Each arc carries the number of words that sort before those behind it, so that the sum along
a path is the word's rank, and the rank finds its ids in one table. The whole lexicon is one block of bytes: arrays
sorted by (state, byte), which a reader maps into memory and searches for many words at once.
"""

from __future__ import annotations

import functools
import json
import mmap
import struct

import numpy as np
import pyarrow as pa

MAGIC = b"STRATLEX"


class Lexicon:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self._arrays = arrays

    @classmethod
    def build(cls, words: dict[str, list[int]]) -> Lexicon:
        """From words (not empty) to their ids."""
        keys = sorted(w.encode() for w in words)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path = [0]  # states along the last word
        last = b""

        def settle(depth: int) -> None:
            """Replaces the states below depth on the last word's path by equal ones."""
            for d in range(len(last), depth, -1):
                s = path[d]
                same = known.setdefault((final[s], *arcs[s].items()), s)
                if same != s:
                    arcs[path[d - 1]][last[d - 1]] = same
                path.pop()

        for w in keys:
            n = 0
            while n < min(len(w), len(last)) and w[n] == last[n]:
                n += 1
            settle(n)
            for b in w[n:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][b] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = w
        settle(0)

        number: dict[int, int] = {0: 0}
        order = [0]
        for s in order:  # states that are still reached, in breadth-first order
            for t in arcs[s].values():
                if t not in number:
                    number[t] = len(number)
                    order.append(t)
        below: dict[int, int] = {}
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
            elif s not in below:
                stack.append((s, True))
                stack += [(t, False) for t in arcs[s].values() if t not in below]
        key, target, skip = [], [], []
        for s in order:
            before = int(final[s])
            for b, t in sorted(arcs[s].items()):
                key.append(number[s] << 8 | b)
                target.append(number[t])
                skip.append(before)
                before += below[t]
        ids = [words[w.decode()] for w in keys]
        starts = np.zeros(len(ids) + 1, np.uint32)
        np.cumsum([len(x) for x in ids], out=starts[1:])
        return cls({
            "arc_key": np.array(key, np.uint64), "arc_target": np.array(target, np.uint32), "arc_skip": np.array(skip, np.uint32),
            "final": np.array([final[s] for s in order], np.uint8), "starts": starts,
            "ids": np.array([i for x in ids for i in x], np.uint32),
        })

    def to_bytes(self) -> bytes:
        head, body, at = {}, [], 0
        for k, a in self._arrays.items():
            raw = a.tobytes()
            head[k] = (a.dtype.str, at, len(a))
            raw += b"\0" * (-len(raw) % 8)
            body.append(raw)
            at += len(raw)
        h = json.dumps(head).encode()
        h += b" " * (-len(h) % 8)
        return MAGIC + struct.pack("<Q", len(h)) + h + b"".join(body)

    @classmethod
    def from_buffer(cls, raw) -> Lexicon:
        """Over bytes, or a memory map of a file of to_bytes()."""
        assert bytes(raw[:8]) == MAGIC, "not a lexicon"
        n = struct.unpack("<Q", raw[8:16])[0]
        return cls({k: np.frombuffer(raw, np.dtype(d), count, 16 + n + at) for k, (d, at, count) in json.loads(bytes(raw[16 : 16 + n])).items()})

    @classmethod
    def mapped(cls, raw: bytes) -> Lexicon:
        """In an anonymous memory map: its pages lie outside Python's heap and are read in place."""
        m = mmap.mmap(-1, len(raw))
        m[:] = raw
        return cls.from_buffer(m)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls.from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if it isn't in the lexicon; all words take a step at a time."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        return self._find(np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n, n)

    def find_column(self, words: pa.Array) -> np.ndarray:
        """find() over an Arrow column without nulls, in place."""
        _, offsets, data = words.buffers()
        off = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
        flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return self._find(flat, off[:-1], np.diff(off))

    def _find(self, flat: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.full(len(n), -1, np.int64)
        if not len(n) or not len(self.arc_key):
            return out
        alive = np.flatnonzero(n > 0)
        state, rank = np.zeros(len(alive), np.uint64), np.zeros(len(alive), np.int64)
        j = 0
        while len(alive):
            key = state << np.uint64(8) | flat[off[alive] + j]
            i = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            ok = self.arc_key[i] == key
            alive, i = alive[ok], i[ok]
            rank = rank[ok] + self.arc_skip[i]
            state = self.arc_target[i].astype(np.uint64)
            j += 1
            ends = n[alive] == j
            done = ends & (self.final[state] == 1)
            out[alive[done]] = rank[done]
            alive, state, rank = alive[~ends], state[~ends], rank[~ends]
        return out

    @functools.cached_property
    def values(self) -> pa.Array:
        """The ids of each rank, as binary values over the same memory."""
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.starts) - 1, [None, pa.py_buffer((self.starts * 4).astype(np.int32)), pa.py_buffer(self.ids)])

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.starts[rank] : self.starts[rank + 1]]

    @property
    def states(self) -> int:
        return len(self.final)

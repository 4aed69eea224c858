"""Exact byte-pair merges for whole Arrow batches, for the two kinds of tokenizer file that are used.

A batch's texts are cut where no token can span, its distinct chunks are encoded once, and the ids of all chunks are
gathered by position; all three run in Arrow's kernels. A chunk is looked up in the lexicon first, if there is one, then
in a bounded memo; what neither holds is merged: chunks of Latin letters, digits and signs by ranks in one call for all,
chunks with other characters by the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks that a memo keeps; beyond that only those of the current batch stay, which changes no result.
MEMO = 200_000

#: Characters of chunks that go through the library: all but tab, line ends, ASCII and Latin letters, and one whose lower case is two.
ODD = r"[^\t\n\r\x20-\x7e\x{a1}-\x{17f}]|\x{130}"
#: White space that seldom stands in a text.
RARE = r"\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CUT = re.compile(r"(?<=\S)(?= )")
#: The byte-level files' pattern, without its last two alternatives for white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+"


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def blobs(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values of little-endian int32 ids: those of data between each two bounds."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(data.astype("<i4"))])


def id_lists(ids: pa.Array) -> pa.Array:
    """Binary values of int32 ids as lists of them, over the same bytes."""
    _, offsets, data = ids.buffers()
    off = np.frombuffer(offsets, np.int32, len(ids) + 1, ids.offset * 4) // 4
    n = int(off[-1]) if len(off) else 0
    return pa.ListArray.from_arrays(pa.array(off), pa.Array.from_buffers(pa.int32(), n, [None, data if data is not None else pa.py_buffer(b"")]))


class Merger:
    """spec: the text of a tokenizers file. lexicon: ids of frequent chunks. memo: chunks to remember, 0 for none."""

    def __init__(self, spec: str, lexicon=None, memo: int = MEMO):
        j = json.loads(spec)
        model, signs = j["model"], byte_signs()
        self.spec = spec
        self.lexicon, self.limit = lexicon, memo
        self.suffix = model.get("end_of_word_suffix") or ""
        special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # texts that aren't simply words with one space between each two
        marks = "|".join(map(re.escape, special))
        self.unusual = rf"  |[\n\t\r] |^ | $|[{RARE}]" + (f"|{marks}" if marks else "")
        self.odd = f"{ODD}|{marks}" if marks else ODD

        def raw(token: str) -> bytes:
            word_end = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            return bytes(signs[c] for c in (token[: -len(self.suffix)] if word_end else token)) + b"\0" * word_end

        vocab = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        made = [a + b for a, b in merges]
        merged = set(made)
        single = [t for t in vocab if t not in merged]
        ranks, id_of = {}, []
        if self.suffix:
            single.sort(key=lambda t: (not raw(t).endswith(b"\0") or len(raw(t)) < 2, t))
        for t in [*single, *made]:
            b = raw(t)
            if b not in ranks:
                ranks[b] = len(ranks)
                id_of.append(vocab[t])
        if b"\0" not in ranks:  # the sign of a word's end, which never stays alone
            ranks[b"\0"] = len(ranks)
            id_of.append(-1)
        self.id_of, self.end = np.array(id_of, np.int32), ranks[b"\0"]
        if self.suffix:
            (pattern,) = [p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
            self.piece, patterns = f"({pattern})", ["[^\x00]*\x00"]
        else:
            patterns = ["\x00|" + WORDS, "\x00|" + WORDS + r"|\s+(?![^\s\x00])|\s+"]
        self.engines = [tiktoken.Encoding(f"merges{i}", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for i, p in enumerate(patterns)]
        text_of = {i: (t.encode() if t in special else raw(t).rstrip(b"\0") if self.suffix else raw(t)) for t, i in [*vocab.items(), *special.items()]}
        self.tokens = pa.array([text_of.get(i) for i in range(max(text_of) + 1)], pa.binary())
        self.forget()

    @functools.cached_property
    def library(self):
        """Loaded only if a text needs it, as it holds some 30 MB."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.spec)
        out.no_truncation()
        out.no_padding()
        return out

    def forget(self) -> None:
        self.keys, self.values = pa.array([], pa.string()), pa.array([], pa.binary())

    # ---- chunks of texts

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct chunks (byte-level: with the space that leads them), each place's number of a chunk, and where each text's places
        begin. Tokens never hold a space but at their start or in a run of white space, so a text may be cut before a space
        that follows another character."""
        lists = pc.split_pattern(texts, " ")
        begin = np.asarray(lists.offsets).astype(np.int64)
        # a text cut in no piece at all never occurs: an empty one is one empty piece
        coded = lists.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
        begin = begin - begin[0]
        code, uniq = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        if self.suffix:
            return uniq, code, begin
        first = coded.dictionary.take(pa.array(code[begin[:-1]])).dictionary_encode()
        code[begin[:-1]] = len(uniq) + np.asarray(first.indices)
        return pa.concat_arrays([pc.binary_join_element_wise("", uniq, " "), first.dictionary]), code, begin

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (null: empty), as lists."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        rare = None if self.suffix else pc.match_substring_regex(texts, self.unusual)
        if rare is None or not pc.any(rare).as_py():
            return self._encode_simple(texts)
        where = np.asarray(rare.cast(pa.uint8())).astype(bool)
        own = self._encode_unusual(texts.filter(rare).to_pylist())
        if where.all():
            return own
        simple = self._encode_simple(texts.filter(pc.invert(rare)))
        at = np.empty(len(texts), np.int64)
        at[~where], at[where] = np.arange(len(simple)), len(simple) + np.arange(len(own))
        return pa.concat_arrays([simple, own]).take(pa.array(at))

    def _encode_simple(self, texts: pa.Array) -> pa.Array:
        uniq, code, begin = self.chunks(texts)
        return self._gathered(self.chunk_ids(uniq), code, begin)

    @staticmethod
    def _gathered(ids: pa.Array, code: np.ndarray, begin: np.ndarray) -> pa.Array:
        flat = id_lists(ids.take(pa.array(code)))
        return pa.ListArray.from_arrays(flat.offsets.take(pa.array(begin)), flat.values)

    def _encode_unusual(self, texts: list[str]) -> pa.Array:
        """Texts with runs of white space are cut before a space that follows another character; special tokens stand alone."""
        places, begin = [], [0]
        for t in texts:
            last = 0
            for m in self.special.finditer(t) if self.special else ():
                places += CUT.split(t[last : m.start()]) if m.start() > last else []
                places.append(m[0])
                last = m.end()
            places += CUT.split(t[last:]) if last < len(t) else []
            begin.append(len(places))
        coded = pa.array(places, pa.string()).dictionary_encode()
        return self._gathered(self.chunk_ids(coded.dictionary), np.asarray(coded.indices).astype(np.int64), np.array(begin))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian int32."""
        return [np.asarray(x.values, "<i4").tobytes() for x in self.encode_column(pa.array(texts, pa.string()))]

    # ---- back to text

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids (null: empty); bytes that are no UTF-8 become the replacement sign."""
        if not len(ids):
            return pa.array([], pa.string())
        bounds = np.asarray(ids.offsets).astype(np.int64)
        parts = self.tokens.take(ids.values.slice(bounds[0], bounds[-1] - bounds[0]))
        if parts.null_count:
            raise ValueError("ids outside the vocabulary")
        _, offsets, data = parts.buffers()
        at = np.frombuffer(offsets, np.int32, len(parts) + 1)[bounds - bounds[0]]
        out = pa.StringArray.from_buffers(len(ids), pa.py_buffer(at.astype(np.int32)), data if data is not None else pa.py_buffer(b""))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([x.as_py().decode("utf-8", "replace") for x in out.view(pa.binary())], pa.string())
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens.take(pa.array(ids, pa.int64())).to_pylist())

    # ---- ids of chunks

    def chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk: from the lexicon, else from the memo, else merged."""
        at = np.full(len(chunks), -1, np.int64)
        tables = []
        if self.lexicon is not None:
            at = self.lexicon.find_column(chunks)
            tables.append(self.lexicon.values)
        base = sum(map(len, tables))
        left = np.flatnonzero(at < 0)
        if self.limit and len(self.keys) and len(left):
            known = pc.fill_null(pc.index_in(chunks.take(pa.array(left)), value_set=self.keys), -1)
            known = np.asarray(known).astype(np.int64)
            at[left[known >= 0]] = base + known[known >= 0]
            left = left[known < 0]
        tables.append(self.values)
        base += len(self.values)
        new = chunks.take(pa.array(left))
        made = self.merge(new)
        at[left] = base + np.arange(len(left))
        out = pa.concat_arrays([*tables, made]).take(pa.array(at))
        if self.limit:
            if len(self.keys) + len(new) > self.limit:
                self.keys, self.values = (new, made) if self.lexicon is not None else (chunks, out)
            else:
                self.keys, self.values = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.values, made])
        return out

    def merge(self, chunks: pa.Array) -> pa.Array:
        if not len(chunks):
            return pa.array([], pa.binary())
        kind = np.asarray(pc.match_substring_regex(chunks, self.odd).cast(pa.int8())) * 2
        if not self.suffix:  # white space within a chunk takes a pattern that looks ahead
            kind = np.where(kind, kind, np.asarray(pc.match_substring_regex(chunks, r"[\t\n\r]| $|  ").cast(pa.int8())))
        made, order = [], []
        for k in range(3):
            where = np.flatnonzero(kind == k)
            if len(where):
                part = chunks.take(pa.array(where))
                made.append(self._by_library(part) if k == 2 else self._by_ranks(part, k))
                order.append(where)
        if len(made) == 1:
            return made[0]
        back = np.empty(len(chunks), np.int64)
        back[np.concatenate(order)] = np.arange(len(chunks))
        return pa.concat_arrays(made).take(pa.array(back))

    def _by_library(self, chunks: pa.Array) -> pa.Array:
        ids = [np.array(e.ids, np.int32) for e in self.library.encode_batch(chunks.to_pylist(), add_special_tokens=False)]
        return blobs(np.cumsum([0, *map(len, ids)]), np.concatenate(ids))

    def _ended(self, chunks: pa.Array) -> pa.Array:
        """Lower-case chunks with a sign of its end behind each piece. Words, and words with one sign behind, need no search."""
        letters = r"[a-z\x{df}-\x{f6}\x{f8}-\x{17f}]+"
        word = pc.match_substring_regex(chunks, f"^{letters}$")
        signed = pc.match_substring_regex(chunks, f"^{letters}[!-&(-/:-@]$")
        other = pc.invert(pc.or_(word, signed))
        out = pc.binary_join_element_wise(chunks, "", "\0")
        part = chunks.filter(signed)
        out = pc.replace_with_mask(out, signed, pc.binary_join_element_wise(pc.utf8_slice_codeunits(part, 0, -1), pc.utf8_slice_codeunits(part, -1), "", "\0"))
        part = pc.replace_substring_regex(pc.replace_substring_regex(chunks.filter(other), self.piece, "\\1\0"), r"\s+", "")
        return pc.replace_with_mask(out, other, part)

    def _by_ranks(self, chunks: pa.Array, engine: int) -> pa.Array:
        """All chunks in one string, with a sign behind each that is a token of its own."""
        if self.suffix:
            chunks = self._ended(pc.utf8_lower(chunks))
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "\0")[0].as_py() + "\0"
        ranks = np.array(self.engines[engine].encode_ordinary(whole), np.int32)
        ends = np.flatnonzero(ranks == self.end)
        return blobs(np.concatenate([[0], ends - np.arange(len(ends))]), self.id_of[ranks[ranks != self.end]])


@functools.lru_cache(maxsize=1)
def merger(spec: str, lexicon: str = "", memo: int = MEMO) -> Merger:
    """One for a worker, as its tables take a second to build. lexicon: the name of a file that Spark sent along."""
    from pyspark import SparkFiles

    from .lexicon import Lexicon

    return Merger(spec, Lexicon.open(SparkFiles.get(lexicon)) if lexicon else None, memo)

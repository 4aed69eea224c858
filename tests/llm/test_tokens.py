import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataspark.llm import bpe, tokenbin
from strataspark.llm.common import tokenizer_path
from strataspark.llm.lexicon import Lexicon
from strataspark.llm.merging import Merger
from strataspark.llm.tokenbin import WaveletMatrix

ODD = ["", " ", "  a  b", "a\n b\t c ", "don't 's 'LL", "x<|endoftext|> y<|startoftext|>", "ÀÉ İstanbul ΑΣ ß ª²½", "a\x85b \x1c\xa0c", "中文 字 テスト é́", "\x00a b\x00", "😀 a😀b", "z" * 5000, "\r\n a \r\n", "1234 56a 7,8"]


def odd_texts(n=1500):
    rnd = random.Random(3)
    letters = " \n\t \x1c\x85abcÀß²'s.,!<|1é"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("name", [bpe.FILE, tokenbin.FILE])
def test_merging_equals_the_library(name):
    spec = bpe.read_spec(tokenizer_path(name))
    m, library = Merger(spec), Tokenizer.from_str(spec)
    texts = odd_texts()
    for t, got in zip(texts, m.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<i4").tolist() == want, repr(t)
        if name == bpe.FILE:
            assert m.decode(want).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_lexicon_finds_all_words_and_shares_suffixes():
    words = {a + b: [i, j] for i, a in enumerate(("read", "walk", "é", "x")) for j, b in enumerate(("ing", "ed", "er", "s"))}
    lex = Lexicon.mapped(Lexicon.build(words).to_bytes())
    ranks = lex.find([w.encode() for w in words] + [b"rea", b"readingx", b"", b"zz"])
    assert (ranks[-4:] == -1).all()
    assert all(lex.ids_of(r).tolist() == ids for r, ids in zip(ranks, words.values(), strict=False))
    assert lex.states < 25  # a tree of these words has more than 50
    assert sorted(ranks[:-4]) == list(range(len(words)))


def test_lexicon_may_be_empty():
    lex = Lexicon.from_buffer(Lexicon.build({}).to_bytes())
    assert lex.find([b"a"]).tolist() == [-1]


def test_round_trip_with_odd_rows(spark):
    rows = [(i, t, "kept", [1]) for i, t in enumerate(ODD)] + [(1, "  a  b", "again", None), (None, None, "null", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    library = Tokenizer.from_file(tokenizer_path(bpe.FILE))
    got = bpe.round_trip(df, lexicon_words=5).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(df.limit(0)).collect() == []


def test_frequent_words_count_all_texts(spark):
    df = spark.createDataFrame([("a b a",), ("a c",), (None,), ("",)], "text string").repartition(3)
    spec = bpe.read_spec(tokenizer_path(bpe.FILE))
    assert bpe.frequent_words(df, spec, size=100) == sorted(["a", " a", " b", " c"])
    assert bpe.frequent_words(df, spec, size=1) == ["a"]  # the one word that occurs twice
    assert bpe.frequent_words(df.limit(0), spec) == []


def test_wavelet_matrix_answers_as_the_plain_list():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (700, 1), (5000, 49408), (3001, 7)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        w = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, np.array([0, n])).to_bytes())
        assert w.all().tolist() == ids.tolist()
        for i in rng.integers(0, max(1, n), 20):
            if n:
                assert w.access(int(i)) == ids[i]
        for v in {0, 1, 5, top, *ids[:5].tolist()}:
            where = np.flatnonzero(ids == v)
            assert w.count(v) == len(where)
            assert w.rank(v, n // 2) == (ids[: n // 2] == v).sum()
            assert w.occurrences(v)[:50] == where.tolist()[:50]
            assert w.select(v, len(where)) == -1


def test_a_document_is_read_by_access_from_the_chunks_it_touches():
    rng = np.random.default_rng(2)
    n = 3 * tokenbin.CHUNK + 77
    ids = rng.integers(0, 40000, n).astype(np.uint16)
    at = np.array([0, 9, tokenbin.CHUNK - 5, tokenbin.CHUNK + 7, n])
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, at).to_bytes())
    assert w.access(n - 1) == ids[n - 1]
    assert len(w.held) <= 2 * w.bits  # of the five pieces of each plane: its samples and one chunk
    assert w.document(0) == ids[:9].tolist()
    assert w.document(2) == ids[at[2] : at[3]].tolist()
    assert w.count(int(ids[5])) == (ids == ids[5]).sum() and w.select(int(ids[n - 1]), w.count(int(ids[n - 1])) - 1) == n - 1
    assert (w.all() == ids).all()


def test_a_lexicon_holds_words_of_any_script_and_is_mapped_from_a_file(tmp_path):
    spec = bpe.read_spec(tokenizer_path(bpe.FILE))
    library = Tokenizer.from_str(spec)
    words = ["слово", " слово", " λόγος", " 文字", "the", " the,", " don't", " a\n\nb"]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.build_lexicon(words, spec).to_bytes())
    lex = Lexicon.open(str(path))
    assert (lex.find([w.encode() for w in words]) >= 0).all()
    m = Merger(spec, lex, memo=0)
    for t in ("слово λόγος 文字 слово", "the the, don't a\n\nb x", "unseen слово"):
        assert np.frombuffer(m.encode([t])[0], "<i4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_white_space_at_chunk_ends_equals_the_library():
    spec = bpe.read_spec(tokenizer_path(bpe.FILE))
    m, library = Merger(spec), Tokenizer.from_str(spec)
    texts = ["a ", "a \n", "a \n\n", "a\n \n b", " ", "\n", "a\tb\t\t", "a  ", "x y\n\nz w", "a <|endoftext|>", "<|endoftext|> a"]
    for t, got in zip(texts, m.encode(texts), strict=True):
        assert np.frombuffer(got, "<i4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_shards_give_the_documents_back(spark):
    rows = [(5, "b c"), (3, None), (None, "first"), (3, "again"), (9, ""), (-2, "x" * 3000)]
    library = Tokenizer.from_file(tokenizer_path(tokenbin.FILE))
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, start string").repartition(3)
    shards = tokenbin.write_shards(df, bpe.read_spec(tokenizer_path(tokenbin.FILE)), shard_tokens=4)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenbin.read_shards(shards).collect())
    assert [g[1] for g in got] == [None, -2, 3, 3, 5, 9]
    at, want = 0, {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, set()).add((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for start, i, n, crc in got:
        assert start == at and (n, crc) in want[i]
        at += n
    assert tokenbin.token_table(df.limit(0)).collect() == []


def test_queries_equal_the_library(spark, sf):
    from strataspark.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    byte, word = Tokenizer.from_file(tokenizer_path(bpe.FILE)), Tokenizer.from_file(tokenizer_path(tokenbin.FILE))
    for r in queries.op3_bpe(spark, sf).collect():
        ids = byte.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = byte.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got, at = {r.doc_id: r for r in queries.op6_tokens(spark, sf).collect()}, 0
    for i in sorted(docs):
        ids = word.encode(docs[i], add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)

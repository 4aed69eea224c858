import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import chat, langid, quality

SF = "/root/testdata/sf0.01"


# ---- quality


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    idx, val = np.array([3, 7, 7, 20, 49]), rng.normal(size=5)
    slow = 0.3 + (m.w[idx] * val).sum() + sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i in range(5) for j in range(i + 1, 5))
    # a repeated feature meets itself, as in the sum of squares
    assert m.raw(idx, val, np.array([0]))[0][0] == pytest.approx(slow)


def test_quality_held_out_accuracy(spark):
    from strataspark.llm import queries

    got = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in labels)
    assert len(got) == 1000 and np.mean([a == b for a, b in held]) >= 0.93
    good = [a for a, b in held if b == 1]
    assert np.mean(good) >= 0.97  # clean documents stay


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (1, "a b", 0.5), (2, None, 1.0), (3, "", 1.0), (None, "x " * 30000, 2.0)], "doc_id long, text string, score double")
    labels = "doc_id long, quality int"
    none = spark.createDataFrame([], labels)
    assert quality.fit(docs, none) == 1.0
    assert quality.fit(docs, spark.createDataFrame([(1, 1), (2, None)], labels)) == 1.0
    assert quality.fit(docs, spark.createDataFrame([(1, 1), (1, 0)], labels)) == 0.0  # the smallest of several
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 4 != 2]
    many = spark.createDataFrame([(i, "fine words here." if i % 2 else "BAD!! BAD!! BAD!!") for i in ids], "doc_id long, text string")
    model = quality.fit(many, spark.createDataFrame([(i, i % 2) for i in ids], labels))
    again = quality.fit(many.repartition(7), spark.createDataFrame([(i, i % 2) for i in ids], labels))
    assert np.array_equal(model.w, again.w)
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), model).collect() == []
    by = {r.text: r.score for r in quality.score(many, model).collect()}
    assert by["fine words here."] > 0.7 > by["BAD!! BAD!! BAD!!"]


# ---- language


def brute_viterbi(scores, switch):
    v, back = scores[0].astype(float), []
    for e in scores[1:]:
        m = v[:, None] - switch * (1 - np.eye(len(v)))
        back.append(m.argmax(0))
        v = m.max(0) + e
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], v.max()


def test_viterbi_equals_the_table():
    rng = np.random.default_rng(5)
    table = rng.normal(size=(40, 3)).astype(np.float32)
    sizes = np.array([0, 1, 5, 30, 0, 12, 1])
    rows = rng.integers(0, 40, sizes.sum())
    got, at = langid.viterbi(rows, sizes, table, 1.5), 0
    for n in sizes:
        if n:
            e = table[rows[at : at + n]].astype(float)
            path = got[at : at + n]
            total = e[np.arange(n), path].sum() - 1.5 * (path[1:] != path[:-1]).sum()
            assert total == pytest.approx(brute_viterbi(e, 1.5)[1], abs=1e-4)
        at += n


def test_language_held_out_accuracy(spark):
    from strataspark.llm import queries

    got = queries.op2_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) >= 0.97


def test_mixed_text_and_edges(spark):
    rnd = random.Random(1)
    make = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(60))
    rows = [(i, make("abcde" if i % 3 == 0 else "vwxyz" if i % 3 == 1 else "жзикл"), ["xx", "yy", "zz"][i % 3]) for i in range(60)]
    train = spark.createDataFrame([*rows, (None, "q", "xx"), (90, None, "xx"), (91, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["xx", "yy", "zz"]
    mixed = make("abcde") + " " + make("жзикл")
    docs = spark.createDataFrame([(1, mixed, 9), (2, None, 9), (3, "", 9), (4, "12 ... !", 9), (5, "a", 9), (6, make("vwxyz") * 300, 9), (6, "жз", 9)], "doc_id long, text string, score int")
    got = langid.label(docs, model).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert [s.lang for s in one.lang_spans] == ["xx", "zz"] and one.lang_spans[0].end_word == 60 and 0.45 < one.score < 0.55
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, one.lang_pred), (2, "und"), (3, "und"), (4, "und"), (5, "xx"), (6, "yy"), (6, "zz")}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.label(docs, empty).collect()} == {"und"}
    assert langid.label(docs.limit(0), model).collect() == []


# ---- chat


def test_roles_held_out_accuracy(spark):
    from strataspark.llm import queries

    c = spark.read.parquet(f"{SF}/conversations.parquet")
    got = queries.op7_chat(spark, SF).join(c, ["conv_id", "turn"]).collect()
    assert len(got) == c.count()
    held = [r.role == r.role_pred for r in got if zlib.crc32(str(r.conv_id).encode()) % 3 == 1]
    assert np.mean(held) >= 0.95


def model():
    rng = np.random.default_rng(2)
    return chat.Hmm(rng.integers(0, 50, (3, chat.SLOTS)), rng.integers(1, 20, (3, 3)), np.array([5, 5, 0]))


def brute_roles(m, texts):
    e = np.array([m.scores(t or "", k == 0) for k, t in enumerate(texts)])
    v, back = e[0], []
    for x in e[1:]:
        both = v[:, None] + m.move
        back.append(both.argmax(0))
        v = both.max(0) + x
    out = [int(v.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return [chat.ROLES[k] for k in out[::-1]]


def test_long_transcripts_are_decoded_as_a_whole(spark):
    m, rnd = model(), random.Random(3)
    talks = {c: ["word " * rnd.randrange(1, 200) + ("?" if rnd.random() < 0.3 else "") for _ in range(n)] for c, n in ((1, 1), (2, 7), (3, 900))}
    rows = [(c, k, t, "no role") for c, x in talks.items() for k, t in enumerate(x)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role_pred string")
    got = {(r.conv_id, r.turn): r.role_pred for r in chat.roles(df, m).collect()}
    for c, x in talks.items():
        assert [got[c, k] for k in range(len(x))] == brute_roles(m, x)


def test_turns_go_on_over_stretches(spark):
    m, rnd = model(), random.Random(8)
    marks = [r for r in ("User", "Assistant") for _ in range(2)]
    lines = [f"{marks[k // 3 % 4]}: {rnd.randrange(10**6)}" for k in range(3 * chat.STRETCH + 50)]
    df = spark.createDataFrame(list(enumerate(lines)), "turn long, text string").withColumn("conv_id", F.lit(1)).repartition(3)
    got = sorted(chat.canonical(chat.roles(df, m)).collect(), key=lambda r: r.turn)
    want, roles = [], brute_roles(m, lines)
    assert any(roles[k - 1] == roles[k] for k in range(chat.STRETCH, len(lines), chat.STRETCH))
    for k, (r, t) in enumerate(zip(roles, lines, strict=True)):
        if not k or roles[k - 1] != r:
            want.append([r])
        want[-1].append(t.split(": ")[1])
    assert [r.role_pred for r in got] == roles
    assert [r.opens for r in got] == [not k or roles[k - 1] != r for k, r in enumerate(roles)]
    assert "\n".join(r.rendered for r in got) == "\n".join(f"<|{x[0]}|>\n" + "\n".join(x[1:]) + "\n<|end|>" for x in want)


def brute_lines(m, texts):
    """Roles of all lines by the plain recurrence over a whole transcript."""
    e, into, sizes = m.lines_of([(t or "", k == 0) for k, t in enumerate(texts)])
    v, back = e[0], []
    for x, t in zip(e[1:], into[1:], strict=True):
        both = v[:, None] + t
        back.append(both.argmax(0))
        v = both.max(0) + x
    out = [int(v.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return [chat.ROLES[k] for k in out[::-1]], sizes


def test_messages_of_several_speakers_fall_into_parts(spark):
    m, rnd = model(), random.Random(21)
    names = ["User", "Assistant", "System"]
    texts = []
    for _ in range(600):
        lines = []
        for _ in range(rnd.randrange(1, 5)):
            lines.append(rnd.choice(["", f"{rnd.choice(names)}: "]) + "word " * rnd.randrange(0, 30))
        texts.append("\n".join(lines))
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string").repartition(3)
    found = chat.roles(df, m)
    got = sorted(chat.canonical(found).collect(), key=lambda r: r.turn)
    want, sizes = brute_lines(m, texts)
    assert [r for g in got for p in g.parts for r in [p.role] * (p.end - p.first)] == want
    assert sum(len(g.parts) > 1 for g in got) > 50
    # the whole rendered transcript against a plain one
    plain, at, before = [], 0, None
    for t, n in zip(texts, sizes, strict=True):
        for a in range(n):
            role = want[at + a]
            if role != before:
                plain += ([] if before is None else ["<|end|>"]) + [f"<|{role}|>"]
            line = t.split("\n")[a]
            plain.append(line[chat.mark_of(line)[1] :] if a == 0 or role != before else line)  # a part begins here
            before = role
        at += n
    assert "\n".join(r.rendered for r in got) == "\n".join([*plain, "<|end|>"])
    rows = sorted(chat.turns(found).collect(), key=lambda r: (r.turn, r.part))
    assert len(rows) == sum(len(g.parts) for g in got) and [r.role for r in rows if r.begins] == [r for k, r in enumerate(want) if not k or want[k - 1] != r]


def test_markers_weigh_as_much_as_they_are_right(spark):
    rows = [(c, k, f"{'User' if (c + k) % 4 else 'Assistant'}: hello", "user") for c in range(60) for k in range(4)]
    m = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, text string, role string"))
    n = sum(1 for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1)
    assert abs(m.marked - np.log((n * 3 / 4 + 1) / (n / 4))) < 0.01
    assert chat.Hmm(np.zeros((3, chat.SLOTS)), np.zeros((3, 3)), np.zeros(3)).marked == pytest.approx(chat.MARKED)


def test_lengths_of_lines_are_features():
    short, long = (chat.message_features(t, False) for t in ("a\nbb\n" + "c" * 60, "a" * 31 + "\n" + "b" * 31 + "\nc"))
    assert short[:5] == long[:5] and sorted(short[5:]) != sorted(long[5:])


def test_markers_decide_and_go(spark):
    m = model()
    lines = ["System: be kind", "Human: hi there", "### Assistant: hello", "<|user|> more?", "assistant is a word here"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "conv_id long, turn long, text string")
    got = sorted(chat.canonical(chat.roles(df, m)).collect(), key=lambda r: r.turn)
    assert [r.role_pred for r in got[:4]] == ["system", "user", "assistant", "user"]
    assert [r.rendered.split("\n")[1] for r in got] == ["be kind", "hi there", "hello", "more?", "assistant is a word here"]
    assert got[0].rendered == "<|system|>\nbe kind\n<|end|>" and got[0].opens


def test_chat_edges(spark):
    rows = [(1, 0, None, "user"), (1, 0, None, "user"), (1, None, "x", None), (None, 2, "y", "assistant"), (2, 5, "", "nobody"), (2, 700, "z" * 9000, "user")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    m = chat.fit(df)
    got = chat.canonical(chat.roles(df, m)).collect()
    assert len(got) == len(rows) and all(r.role_pred in chat.ROLES for r in got)
    none = df.limit(0)
    assert chat.canonical(chat.roles(none, chat.fit(none))).collect() == []
    assert chat.fit(df.withColumn("role", F.lit(None).cast("string"))).emit.shape == (3, chat.SLOTS)


# ---- whole queries against plain recomputations


def test_op9_equals_all_pairs(spark, sf):
    from strataspark.llm import queries
    from strataspark.llm.common import table

    docs = table(spark, sf, "documents").select("doc_id", "text")
    m, f = quality.fit(docs, table(spark, sf, "labels")), quality.Features()
    got = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        idx, val = f(r.text or "")
        x = m.v[idx].astype(np.float64) * val[:, None]
        pairs = np.triu(x @ x.T, 1).sum()  # every two features
        y = m.w0 + float((m.w[idx].astype(np.float64) * val).sum()) + pairs
        want = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
        g = got[r.doc_id]
        assert abs(g.score - want) < 1e-5 and g.predicted == int(g.score >= 0.7) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op2_equals_a_plain_recurrence(spark, sf):
    from strataspark.llm import queries
    from strataspark.llm.common import table

    docs = table(spark, sf, "documents")
    m = langid.fit(docs)
    got = {r.doc_id: r for r in queries.op2_langid(spark, sf).collect()}
    known: dict = {}
    for r in docs.collect():
        words = (r.text or "").split()
        plain = [langid.letters_of(w) for w in words]
        table_ = []
        for w in plain:
            if w and w not in known:
                known[w] = m.scores([w])[0].astype(float).tolist()
            table_.append(known[w] if w else [0.0] * len(m.langs))
        v, back = list(table_[0]) if table_ else [], []
        for s in table_[1:]:
            best = [max((v[p] - (langid.SWITCH if p != k else 0), p == k, -p) for p in range(len(v))) for k in range(len(v))]
            back.append([k if b[1] else -b[2] for k, b in enumerate(best)])
            v = [b[0] + s[k] for k, b in enumerate(best)]
        path = [max(range(len(v)), key=lambda k: (v[k], -k))] if v else []
        for b in reversed(back):
            path.append(b[path[-1]])
        path = path[::-1]
        letters = [0] * len(m.langs)
        for p, w in zip(path, plain, strict=True):
            letters[p] += len(w)
        g = got[r.doc_id]
        if not sum(letters):
            assert (g.lang_pred, g.score, g.n_spans) == ("und", 0.0, 0)
            continue
        top = max(range(len(letters)), key=lambda k: (letters[k], -k))
        assert g.lang_pred == m.langs[top] and abs(g.score - letters[top] / sum(letters)) < 1e-9
        assert g.n_spans == 1 + sum(a != b for a, b in zip(path, path[1:], strict=False))

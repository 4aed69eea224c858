from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from strataspark.functions import text as X
from strataspark.functions import vectors as V


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>'}" for k, v in values.items()))
    return df.select(col).first()[0]


def test_strip_takes_all_white_space(spark):
    for t in ["　 a b \n", "\x1c\x85x ", "", "  ", None]:
        assert one(spark, X.py_strip("t"), t=t) == (t or "").strip()


def test_percent_encoding(spark):
    for t in ["A b(c)_é*~!'/鳥", ""]:
        assert one(spark, X.percent_encode("t"), t=t) == quote(t, safe="")
        assert one(spark, X.wiki_url(F.lit("ja"), F.col("t")), t=t) == (f"https://ja.wikipedia.org/wiki/{quote(t.replace(' ', '_'), safe='_()')}" if t else "")


def test_names_and_paths(spark):
    assert one(spark, X.safe_component("t"), t="..a b//c?.") == "a_b_c"
    assert one(spark, X.safe_component("t"), t="???") == "item"
    assert one(spark, X.last_segment("t"), t="http://x/entity/Q5//") == "Q5"
    assert one(spark, X.first_id_part("t"), t="x/Q12/y.mp3") == "Q12"
    assert one(spark, X.first_id_part("t"), t="bird/y.mp3") == "bird" and one(spark, X.first_id_part("t"), t="y.mp3") == "unknown"
    assert one(spark, X.audio_id(F.lit("Q12"), "t"), t="Q12/a b/111.mp3") == "Q12_a_b_111"
    assert one(spark, X.file_type(F.col("t"), F.lit("")), t="http://x/a.OGG?z=1.wav") == "ogg"
    assert one(spark, X.rank_name("t"), t=" Sub_Species ") == "sub species"


def test_wiki_text(spark):
    assert one(spark, X.strip_nested(F.col("t"), "{{", "}}"), t="x{{a{{b}}c}}y") == "xc}}y"
    t = "<!-- c\n -->'''A''' [[B|b]] [[C]] [http://x.y z]<ref>r\nr</ref>\n== H ==\n* item\n#n\n;d\n{|t\n|}\n\n\nhttps://e.f end [[画像:q.png|w]] [[Category:K]]"
    assert one(spark, X.wiki_text("t"), t=t).split() == "A b C z H end".split()


def test_sentences(spark):
    t = "Short. This one is long enough to stay. 次の文は二十文字以上あるので、ここに残るはずです。 Tail without an end but long"
    got = one(spark, X.sentences("t"), t=t)
    assert got == ["This one is long enough to stay.", "次の文は二十文字以上あるので、ここに残るはずです。", "Tail without an end but long"]


def test_aliases(spark):
    assert one(spark, X.alias_list("t"), t='["a", " ", "b "]') == ["a", "b"]
    assert one(spark, X.alias_list("t"), t="plain, text") == ["plain, text"]
    assert one(spark, X.alias_list("t"), t="") == [] and one(spark, X.alias_list("t"), t=None) == []


def test_colors(spark):
    import hashlib

    n = 80 + int.from_bytes(hashlib.sha1(b"domain").digest()[:4], "big") % 70
    assert one(spark, X.grey(F.col("t")), t="Domain") == "#" + f"{n:02x}" * 3
    assert one(spark, X.gradient(F.lit(0.5), (0, 10, 255), (5, 20, 0)), t="") == "#020f80"  # 2.5 and 127.5 go to the even number


def test_vectors(spark):
    assert one(spark, V.l2_normalize(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.argmax(F.col("v")), v=[1.0, 5.0, 5.0]) == 1
    assert abs(sum(one(spark, V.softmax(F.col("v")), v=[1000.0, 1001.0])) - 1) < 1e-12
    assert one(spark, V.sigmoid(F.lit(-1000.0)), v=[0.0]) == 0.0 and one(spark, V.softplus(F.lit(1000.0)), v=[0.0]) == 1000.0


def test_lists_and_settings():
    from strataspark.functions import text as X

    assert X.listed(["graph, audio", "Graph,,"], {"graph", "audio", "language"}) == ["graph", "audio"]
    assert X.listed("gl,A", {"GL", "A"}, upper=True) == ["GL", "A"]
    with pytest.raises(ValueError, match="more, other"):
        X.listed("graph,other,more", {"graph"})
    lines = ["# KEY=no", "export KEY='quoted'", "KEY=late"]
    assert X.setting("KEY", " given ", {"KEY": "env"}, lines, "demo") == "given"
    assert X.setting("KEY", " ", {"KEY": "env"}, lines, "demo") == "env"
    assert X.setting("KEY", None, {}, lines, "demo") == "quoted"
    assert X.setting("KEY", None, {"KEY": " "}, ["KEY=", "no line"], "demo") == "demo"


def test_encoder_output_and_noise(spark):
    import numpy as np

    from strataspark.operators import signals

    assert signals.matrix_of([1, 2], 1).shape == (1, 2) and signals.matrix_of([1, 2], 2).shape == (2, 1)
    assert signals.matrix_of(np.zeros((2, 3, 4)), 2).shape == (2, 12) and signals.matrix_of(5, 1).shape == (1, 1)
    with pytest.raises(ValueError):
        signals.matrix_of(np.zeros((3, 2)), 2)
    with pytest.raises(KeyError):
        signals.backend("none")
    assert signals.backend("own", {"own": signals.Backend("own", "file", 8000)}).sample_rate_hz == 8000
    df = spark.createDataFrame([([1.0] * 10, 1000)], "wave array<float>, rate int")
    w = signals.cut_samples(df, "wave", "rate", 2.0, noise=0.005).first()
    x = np.array(w.samples[10:])
    assert len(w.samples) == 2000 and w.samples[:10] == [1.0] * 10 and 0.0045 < x.std() < 0.0055 and abs(x.mean()) < 0.001
    # hops round by themselves: 0.5 s of 3 Hz are 2 samples (half to even), 2.0 s are 6
    assert [r.start for r in signals.windows(spark.createDataFrame([(20, 3)], "n int, rate int"), "n", "rate", 2.5, 0.5).collect()][:2] == [0, 6]

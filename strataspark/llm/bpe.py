"""BPE encoding and decoding through a transducer lexicon of frequent words (operator 3).

1. `frequent_words` counts every word of every text (what stands between spaces, with the space before it) and keeps the
   most frequent, a bounded number.
2. `build_lexicon` compiles these with their ids into a minimal acyclic transducer, one file of a few MB. Spark sends it to
   every executor, also to such as come later, and all workers of a machine map the same file into memory.
3. `encode` looks up a batch's distinct words in it, whatever their script, and merges exactly those it does not hold, so
   that results do not depend on what the lexicon contains. `decode` goes back from ids to text.

Null and empty texts have no ids and decode to the empty string; null lists of ids decode to the empty string. Texts of any
length are cut at spaces, and a worker holds a batch (common.BATCH_BYTES, or one text if that is longer). Repeated rows are
encoded each for itself. Input columns named like an output column are replaced. An empty table gives an empty table and an
empty lexicon.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, discard, extend, ready, shared_file, tokenizer_path
from .lexicon import Lexicon
from .merging import Merger, id_lists, merger

FILE = "byte_bpe_50k.json"
#: Words of the lexicon: about 3 MB of automaton and ids.
LEXICON_WORDS = 100_000
#: Distinct words that a task counts before it hands on its sums.
FLUSH = 400_000


def frequent_words(df: DataFrame, spec: str, text_col: str = "text", size: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most `size`: all words above some count. Words are summed in the tasks first,
    and only the chosen ones reach the driver."""

    def run(batches):
        m = merger(spec, memo=0)
        held, n = [], 0

        def summed():
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": t["word"], "n": t["n_sum"]}).combine_chunks()

        for b in batches:
            texts = pc.fill_null(column(b, text_col), "")
            if not len(texts):
                continue
            words, code, _ = m.chunks(texts)
            held.append(pa.table({"word": words, "n": np.bincount(code, minlength=len(words))}))
            n += len(words)
            if n > FLUSH:
                held = [summed()]
                n = len(held[0])
                if n > FLUSH // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, n = [], 0
        if held:
            yield from summed().to_batches(max_chunksize=50_000)

    counts = cut(df.select(text_col).mapInArrow(run, "word string, n long").where("n > 0 and word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "words")
    step = F.floor(F.log2("n") * 16)
    # a few hundred steps of counts, then no more words than asked for
    steps = sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"])
    least, total = None, 0
    for r in steps:
        total += r["count"]
        if total > size:
            break
        least = r["s"]
    words = [] if least is None else [r.word for r in counts.where(step >= least).select("word").collect()]
    discard(counts)
    return sorted(words)


def build_lexicon(words: list[str], spec: str) -> Lexicon:
    chunks = pa.array([w for w in words if w], pa.string())
    lists = id_lists(Merger(spec, memo=0).merge(chunks)).to_pylist() if len(chunks) else []
    return Lexicon.build(dict(zip(chunks.to_pylist(), lists, strict=True)))


def send(spark: SparkSession, lexicon: Lexicon | None) -> str:
    """Puts a lexicon into the shared folder and has Spark send it to all executors; its name there. The file stays, as
    executors that start later fetch it too."""
    return shared_file(spark, "lexicon", lexicon.to_bytes()) if lexicon is not None else ""


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, spec: str, text_col: str = "text", out_col: str = "ids", lexicon: Lexicon | None = None) -> DataFrame:
    """df with the ids of each whole text."""
    spark = ready(df.sparkSession)
    shared, name = spark.sparkContext.broadcast(spec), send(spark, lexicon)

    def make():
        m = merger(shared.value, name)
        return lambda b: [m.encode_column(column(b, text_col))]

    return extend(df, [(out_col, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, spec: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of each list of ids; bytes that are no UTF-8 become the replacement sign."""
    shared = ready(df.sparkSession).sparkContext.broadcast(spec)

    def make():
        m = merger(shared.value)
        return lambda b: [m.decode_column(column(b, ids_col))]

    return extend(df, [(out_col, T.StringType())], make)


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """df with `ids` and `decoded`, by a lexicon of df's own frequent words. Texts go to a worker once for both."""
    spec = read_spec(path or tokenizer_path(FILE))
    spark = ready(df.sparkSession)
    name = send(spark, build_lexicon(frequent_words(df, spec, text_col, lexicon_words), spec))
    shared = spark.sparkContext.broadcast(spec)

    def make():
        m = merger(shared.value, name)

        def f(b: pa.RecordBatch) -> list:
            ids = m.encode_column(column(b, text_col))
            return [ids, m.decode_column(ids)]

        return f

    return extend(df, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())], make)

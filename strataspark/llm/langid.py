"""Language identification of mixed text (operator 2).

1. Each white-space word has the languages as candidates whose training texts use its letters' script (ranges of code
   points). A word's score for a language is the sum of its character trigrams' log-probabilities there, bounded.
2. Over the words of a text, Viterbi's recurrence finds the languages with the highest sum of scores less SWITCH for each
   change of language. All texts of a batch advance a word at a time.
3. Runs of one language are the spans; the language with most letters is the text's, its share of letters the score.

Fitted on at most TRAIN_ROWS texts with a language, those of the smallest hash of doc_id; trigrams are hashed into a table of
fixed size. A text that is null or has no letter is `und` with score 0 and no span. Without any labelled text every
text is `und`. Ties go to the language that sorts first. Texts of any length are labelled whole, a batch at a time. Clashing columns are replaced; repeated rows are each labelled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_rest, extend, ready, texts

TRAIN_ROWS = 20_000
SLOTS = 1 << 16
SWITCH = 6.0
#: How far a word's scores may lie below its best language's.
BOUND = 4.0
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: First code points of ranges, each up to the next, and the script that stands there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x40000, "other"),
]
_FIRST = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
_CODE = np.array([NAMES.index(s) for _, s in SCRIPTS])


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, each between two line ends, and the words' sizes with these."""
    flat = np.frombuffer("".join(f"\n{w}\n" for w in words).encode("utf-32-le", "replace"), np.uint32)
    return flat, np.fromiter((len(w) + 2 for w in words), np.int64, len(words))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words' trigrams (with the word's ends), and how many each word has."""
    flat, n = _points(words)
    x = flat.astype(np.uint64)
    h = (x[:-2] * np.uint64(0x9E3779B1) ^ x[1:-1] * np.uint64(0x85EBCA77) << np.uint64(7) ^ x[2:] * np.uint64(0xC2B2AE3D) << np.uint64(13)) * np.uint64(0x9E3779B97F4A7C15)
    slot = (h >> np.uint64(48)).astype(np.int64) % SLOTS
    inside = np.ones(len(flat), bool)
    ends = np.cumsum(n)
    inside[ends - 1] = False
    inside[ends - 2] = False
    return slot[inside[: len(slot)]], n - 2


def letters_of(word: str) -> str:
    return "".join(c for c in word if c.isalpha()).lower()


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter; words are not empty."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _CODE[np.searchsorted(_FIRST, first, side="right") - 1]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, script_counts: np.ndarray):
        """counts: trigrams by language and slot. script_counts: words by language and script."""
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.log = np.log((counts + 0.5) / (total + 0.5 * SLOTS)).astype(np.float32) if langs else np.zeros((0, SLOTS), np.float32)
        share = script_counts / np.maximum(1, script_counts.sum(1, keepdims=True))
        self.uses = share >= 0.001  # by language and script

    def scores(self, words: list[str]) -> np.ndarray:
        """By word (letters only, not empty) and language, 0 for the best candidate and down to -BOUND; all 0 where no language
        uses the script."""
        slot, n = trigrams(words)
        starts = np.cumsum(n) - n
        s = np.add.reduceat(self.log[:, slot], starts, axis=1).T
        fits = self.uses[:, scripts_of(words)].T
        s = np.where(fits, s, -np.inf)
        best = s.max(axis=1, keepdims=True)
        return np.where(np.isfinite(best), np.maximum(s - np.where(np.isfinite(best), best, 0), -BOUND), 0).astype(np.float32)


def viterbi(rows: np.ndarray, sizes: np.ndarray, table: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best state of each word. rows: each word's row in table (scores by state), text after text; sizes: words a text."""
    states = table.shape[1]
    path = np.zeros(len(rows), np.int16)
    if states < 2 or not len(rows):
        return path
    order = np.argsort(-sizes, kind="stable")
    n, off = sizes[order], (np.cumsum(sizes) - sizes)[order]
    longest = int(n[0])
    alive = len(n) - np.searchsorted(n[::-1], np.arange(1, longest + 1), side="left")  # texts that have a word t
    best_of, stays = np.zeros(len(rows), np.int16), np.zeros((len(rows), states), bool)
    v = table[rows[off[: alive[0]]]]
    last = v.copy()
    for t in range(1, longest):
        a = alive[t]
        at = off[:a] + t
        v = v[:a]
        top = v.argmax(axis=1)
        floor = v[np.arange(a), top] - switch
        stay = v >= floor[:, None]
        best_of[at], stays[at] = top, stay
        v = np.where(stay, v, floor[:, None]) + table[rows[at]]
        v -= v.max(axis=1, keepdims=True)
        last[:a] = v
    state = last[: alive[0]].argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, 0, -1):
        a = alive[t]
        at = off[:a] + t
        now = state[:a]
        path[at] = now
        state[:a] = np.where(stays[at, now], now, best_of[at])
    path[off[: alive[0]]] = state
    return path


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    base = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_rest(id_col, FOLDS) != HELD_OUT))
    ids = base.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(rows)
    chosen = base.select(id_col, F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text")).join(F.broadcast(ids), id_col)

    def run(batches):
        for b in batches:
            by: dict[str, Counter] = {}
            for lang, t in zip(b.column(b.schema.get_field_index("__lang")).to_pylist(), texts(b, "__text"), strict=True):
                by.setdefault(lang, Counter()).update(t.split())
            for lang, seen in by.items():
                words = [(w, n) for x, n in seen.items() if (w := letters_of(x))]
                if words:
                    slot, size = trigrams([w for w, _ in words])
                    tri = np.bincount(slot, np.repeat([n for _, n in words], size), SLOTS)
                    script = np.bincount(scripts_of([w for w, _ in words]), [n for _, n in words], len(NAMES))
                    both = np.concatenate([tri, script]).astype(np.int64)
                    at = np.flatnonzero(both)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(both[at])], ["lang", "slot", "n"])

    # at most SLOTS + scripts sums for each language
    got = chosen.select("__lang", "__text").mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(langs), SLOTS + len(NAMES)))
    if langs:
        counts[[langs.index(x) for x in got["lang"].to_pylist()], got["slot"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts[:, :SLOTS], counts[:, SLOTS:])


class Labeller:
    """Scores of words are kept in a bounded table."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1, np.int64)

    def __call__(self, many: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (first word, end, language) of each text."""
        langs = self.model.langs
        split = [t.split() for t in many]
        if len(self.rows) > 300_000:
            self.clear()
        new = list({w for x in split for w in x if w not in self.rows})
        plain = [letters_of(w) for w in new]
        have = [i for i, w in enumerate(plain) if w]
        at = len(self.table)
        for w in new:
            self.rows[w] = 0
        if have and langs:
            self.table = np.concatenate([self.table, self.model.scores([plain[i] for i in have])])
            self.letters = np.concatenate([self.letters, [len(plain[i]) for i in have]])
            self.rows.update((new[i], at + k) for k, i in enumerate(have))
        sizes = np.array([len(x) for x in split], np.int64)
        get = self.rows.__getitem__
        flat = np.fromiter((r for x in split for r in map(get, x)), np.int64, int(sizes.sum()))
        path = viterbi(flat, sizes, self.table, self.switch)
        weight = self.letters[flat]
        out, at = [], 0
        for n in sizes.tolist():
            p, w = path[at : at + n], weight[at : at + n]
            at += n
            total = int(w.sum())
            if not total or not langs:
                out.append((UNKNOWN, 0.0, []))
                continue
            by = np.bincount(p, w, len(langs))
            cut = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), n]
            best = int(by.argmax())
            out.append((langs[best], float(by[best] / total), [(a, b, langs[p[a]]) for a, b in zip(cut, cut[1:], strict=False)]))
        return out


def label(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score, and lang_spans: first word, end (exclusive) and language, in words of the text."""
    shared = ready(df.sparkSession).sparkContext.broadcast(model)
    span = T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("lang", T.StringType())])

    def make():
        f = Labeller(shared.value)

        def run(b: pa.RecordBatch) -> list:
            got = f(texts(b, text_col))
            return [[x for x, _, _ in got], [x for _, x, _ in got], [[{"first_word": a, "end_word": e, "lang": s} for a, e, s in x] for _, _, x in got]]

        return run

    return extend(df, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lang_spans", T.ArrayType(span))], make)

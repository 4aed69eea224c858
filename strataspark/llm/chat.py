"""Roles of transcript lines by a hidden Markov model, and canonical chat turns (operator 7).

A transcript is a table of messages in order, each of one or more lines, and the lines are the observations. A line's features are a
speaker marker at its start (one of MARKERS) and its length; a message's first line also has those of its message: whether it
opens the transcript, how long it is, how many lines it has, whether it ends with a question mark. Hidden states are the roles.
Between messages roles follow transition odds; from line to line within a message the role stays, but may switch (SWITCH) where a
line has a marker, so a message that holds several speakers' lines falls into parts. Emissions, transitions and how far markers
are to be trusted are counted from transcripts with known roles (a few hundred sums); without any, a marker has log odds of MARKED.
Viterbi's recurrence gives the roles; neighbouring parts of one role are one turn, rendered as `<|role|>\\ntext\\n<|end|>` without
markers, a line of text for each message's.

A transcript of any length is split into stretches of STRETCH turn numbers: each stretch gives its best-path table (states
by states), the tables of a long transcript are combined in order, and stretches are decoded each for itself between
known end states. So one conversation that holds a third of all rows is many small pieces of work.

Null texts are empty messages; null turns come first, null conv_ids are one conversation; equal turn numbers keep the order of
role-free content (text, nulls first). Repeated rows are messages like others. Without rows with known roles the priors decide. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, ready

ROLES = ["system", "user", "assistant"]
#: Words that mark a speaker, by role.
MARKERS = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "question", "customer", "q"],
    "assistant": ["assistant", "ai", "bot", "answer", "agent", "gpt", "a"],
}
STRETCH = 256
FOLDS, HELD_OUT = 3, 1
_WORDS = {w: ROLES.index(r) for r, ws in MARKERS.items() for w in ws}
MARK = re.compile(r"^\s*(?:#{1,4}\s*|<\|?|\[|\*{1,2})?(" + "|".join(sorted(_WORDS, key=len, reverse=True)) + r")(?:\|?>|\]|\*{1,2})?\s*(?::|(?<=[>\]])|$)\s*", re.IGNORECASE)
MARKED = 12.0  # log odds of a marker for its role, as long as nothing is counted
SWITCH = -4.0  # log odds of another role from a line with a marker on, within a message
BUCKETS = 12


def mark_of(line: str) -> tuple[int, int]:
    """The role that a line's marker names (-1: none), and where the text behind it begins."""
    m = MARK.match(line)
    return (_WORDS[m[1].lower()], m.end()) if m else (-1, 0)


def message_features(text: str, first: bool) -> list[int]:
    """Slots of a message's features in the table of emission counts; one for the length of each of its lines."""
    n = min(BUCKETS - 1, len(text).bit_length())
    fine = min(BUCKETS - 1, len(text) // 100)
    lines = min(BUCKETS - 1, text.count("\n"))
    of_lines = [LINES + min(BUCKETS - 1, len(x).bit_length()) for x in text.split("\n")]
    return [n, BUCKETS + fine, 2 * BUCKETS + lines, 3 * BUCKETS + first, 3 * BUCKETS + 2 + text.rstrip().endswith("?"), *of_lines]


LINES = 3 * BUCKETS + 4
SLOTS = LINES + BUCKETS
GROUPS = [(0, BUCKETS), (BUCKETS, 2 * BUCKETS), (2 * BUCKETS, 3 * BUCKETS), (3 * BUCKETS, 3 * BUCKETS + 2), (3 * BUCKETS + 2, LINES), (LINES, SLOTS)]


def line_features(line: str) -> int:
    return LINES + min(BUCKETS - 1, len(line).bit_length())


class Hmm:
    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray, marks: tuple[float, float] = (0, 0)):
        """Counts: features by role and slot, role after role, first role; messages whose marker names their role, and another."""
        log = np.zeros((len(ROLES), SLOTS))
        for a, b in GROUPS:
            part = emit[:, a:b] + 1.0
            log[:, a:b] = np.log(part / part.sum(1, keepdims=True))
        self.emit = log
        self.move = np.log((move + 1.0) / (move + 1.0).sum(1, keepdims=True))
        self.begin = np.log((begin + 1.0) / (begin + 1.0).sum())
        self.marked = float(np.log((marks[0] + 1) / (marks[1] + np.exp(-MARKED))))
        self.stays = np.where(np.eye(len(ROLES)) > 0, 0.0, -np.inf)
        self.may_switch = np.where(np.eye(len(ROLES)) > 0, np.log1p(-(len(ROLES) - 1) * np.exp(SWITCH)), SWITCH)

    def lines(self, text: str, first: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of a message's lines by role, and the transitions into each; into the first: from the message before."""
        split = text.split("\n")
        e = np.array([self.emit[:, line_features(x)] for x in split])
        into = [self.move]
        for k, x in enumerate(split):
            role, _ = mark_of(x)
            if role >= 0:
                e[k, role] += self.marked
            if k:
                into.append(self.may_switch if role >= 0 else self.stays)
        n = len(message_features(text, first)) - len(split)
        e[0] += self.emit[:, message_features(text, first)[:n]].sum(1) + (self.begin if first else 0)
        return e, into

    def scores(self, text: str, first: bool) -> np.ndarray:
        """Of a message by role, if all its lines have one."""
        return self.lines(text, first)[0].sum(0)

    def table(self, e: np.ndarray, into: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Best sums over lines with scores e, by the role before the first and the role of the last; and the first role."""
        m = into[0] + e[0]
        first = np.tile(np.arange(len(ROLES)), (len(ROLES), 1))
        for x, t in zip(e[1:], into[1:], strict=True):
            both = m[:, :, None] + t[None]
            first = np.take_along_axis(first, both.argmax(1), 1)
            m = both.max(1) + x
        return m, first

    def decode(self, e: np.ndarray, into: list[np.ndarray], before: int = -1, last: int = -1) -> list[int]:
        """The best roles of lines with scores e; before: the role ahead of them, last: that of the last, if known."""
        v, back = e[0] + (into[0][before] if before >= 0 else 0), []
        for x, t in zip(e[1:], into[1:], strict=True):
            both = v[:, None] + t
            back.append(both.argmax(0))
            v = both.max(0) + x
        r = last if last >= 0 else int(v.argmax())
        out = [r]
        for b in reversed(back):
            r = int(b[r])
            out.append(r)
        return out[::-1]

    def lines_of(self, messages: list[tuple[str, bool]]) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
        """lines() of several messages in a row, and how many each has."""
        got = [self.lines(t, f) for t, f in messages]
        return np.concatenate([e for e, _ in got]), [t for _, into in got for t in into], [len(e) for e, _ in got]


def fit(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Hmm:
    """From all messages of transcripts that are not held out and whose role is known."""
    base = messages.where(F.coalesce(F.crc32(F.col(conv_col).cast("string")) % FOLDS != HELD_OUT, F.lit(True)))
    base = base.select(F.col(conv_col).alias("c"), F.floor(F.col(turn_col) / STRETCH).alias("g"), F.col(turn_col).alias("n"), F.col(role_col).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    firsts = base.groupBy("c").agg(F.min("n").alias("n0")).withColumnRenamed("c", "c2")

    def run(batches):
        emit, move, begin, marks = np.zeros((len(ROLES), SLOTS), np.int64), np.zeros((len(ROLES),) * 2, np.int64), np.zeros(len(ROLES), np.int64), np.zeros(2, np.int64)
        last = None
        for b in batches:
            for c, g, n, r, t, n0 in zip(*(x.to_pylist() for x in b.columns), strict=True):
                k = ROLES.index(r) if r in ROLES else -1
                if k >= 0:
                    np.add.at(emit[k], message_features(t, n == n0), 1)
                    begin[k] += n == n0
                    marker, _ = mark_of(t.split("\n", 1)[0])
                    if marker >= 0:
                        marks[int(marker != k)] += 1
                    if last is not None and last[:2] == (c, g) and last[2] >= 0:
                        move[last[2], k] += 1
                last = (c, g, k)
        flat = np.concatenate([emit.ravel(), move.ravel(), begin, marks])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["slot", "n"])

    dealt = base.join(firsts, F.col("c").eqNullSafe(F.col("c2"))).select("c", "g", "n", "r", "t", "n0").repartition("c", "g").sortWithinPartitions("c", "g", "n", "t")
    size = len(ROLES) * SLOTS + len(ROLES) ** 2 + len(ROLES) + 2
    flat = np.zeros(size)
    for r in dealt.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        flat[r.slot] = r.n
    a, b = len(ROLES) * SLOTS, len(ROLES) ** 2
    return Hmm(flat[:a].reshape(len(ROLES), SLOTS), flat[a : a + b].reshape(len(ROLES), -1), flat[a + b : -2], tuple(flat[-2:]))


def _stretches(batches, width: int):
    """Runs of sorted rows with equal first two columns, as lists of rows."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns[:width]), strict=True):
            if rows and row[:2] != key:
                yield rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield rows


def roles(messages: DataFrame, model: Hmm, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv_id, turn, text (as it was) and role_pred (of its first line) of every message, whether it opens and closes a turn (the line
    before or after it in the transcript, of whatever stretch, is of another role or there is none), and its parts by role: first
    line, end, role."""
    spark = ready(messages.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    base = messages.select(F.col(conv_col).alias("c"), F.floor(F.col(turn_col) / STRETCH).cast("long").alias("g"), F.col(turn_col).alias("n"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(text_col).alias("raw"))
    ends = base.groupBy("c").agg(F.min("n").alias("n0"), F.min(F.coalesce("g", F.lit(-(1 << 62)))).alias("g0"), F.max(F.coalesce("g", F.lit(-(1 << 62)))).alias("g1"), F.max(F.when(F.col("n").isNull(), True)).alias("has_null"))
    tagged = base.join(ends.withColumnRenamed("c", "c2"), F.col("c").eqNullSafe(F.col("c2"))).drop("c2")
    # the first message of a conversation: that of the least turn, null ahead of all
    tagged = tagged.withColumn("first", F.when(F.col("has_null"), F.col("n").isNull()).otherwise(F.col("n") == F.col("n0"))).withColumn("long", F.col("g0") < F.col("g1"))

    def sorted_(t: DataFrame) -> DataFrame:
        return t.repartition("c", "g").sortWithinPartitions("c", "g", "n", "t")

    def tables(batches):
        m = shared.value
        for rows in _stretches(batches, 4):
            e, into, _ = m.lines_of([(t, bool(f)) for _, _, t, f in rows])
            best, opening = m.table(e, into)
            if rows[0][3]:
                best = np.tile(_from_start(e, into), (len(ROLES), 1))
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], kind), pa.array([rows[0][1]], pa.int64()), pa.array([best.ravel().tolist()], pa.list_(pa.float64())), pa.array([opening.ravel().tolist()], pa.list_(pa.int32()))], ["c", "g", "best", "opening"])

    conv_type = base.schema["c"].dataType
    kind = to_arrow_type(conv_type)
    per = cut(sorted_(tagged.where("long").select("c", "g", "n", "t", "first")).select("c", "g", "t", "first").mapInArrow(tables, f"c {conv_type.simpleString()}, g long, best array<double>, opening array<int>"), "tables")

    def chain(t: pa.Table) -> pa.Table:
        order = sorted(range(t.num_rows), key=lambda i: (t["g"][i].is_valid, t["g"][i].as_py() or 0))
        best = [np.array(t["best"][i].as_py()).reshape(len(ROLES), -1) for i in order]
        v, back = best[0].max(0), []
        for m in best[1:]:
            both = v[:, None] + m
            back.append(both.argmax(0))
            v = both.max(0)
        last = [int(v.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last = last[::-1]
        openings = [t["opening"][i].as_py() for i in order]
        after = [openings[i + 1][last[i] * len(ROLES) + last[i + 1]] for i in range(len(order) - 1)]
        return pa.table({"c": t["c"].take(pa.array(order)), "g": t["g"].take(pa.array(order)), "before": pa.array([-1, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32()), "after": pa.array([*after, -1], pa.int32())})

    # one small row for each stretch of a long conversation
    known = per.groupBy("c").applyInArrow(chain, f"c {conv_type.simpleString()}, g long, before int, last int, after int").toDF("c2", "g2", "before", "last", "after")
    both = tagged.join(known, F.col("c").eqNullSafe(F.col("c2")) & F.col("g").eqNullSafe(F.col("g2")), "left")
    turn_type = base.schema["n"].dataType

    def decode(batches):
        m = shared.value
        for rows in _stretches(batches, 9):
            e, into, sizes = m.lines_of([(r[3], bool(r[5])) for r in rows])
            before, last, after = (-1 if x is None else x for x in rows[0][6:9])
            got = m.decode(e, into, before, last)
            turned = [x != y for x, y in zip([before, *got], [*got, after], strict=True)]  # before each line, and behind the last
            parts, firsts, ends, at = [], [], [], 0
            for n in sizes:
                cuts = [0, *(k for k in range(1, n) if turned[at + k]), n]
                parts.append([{"first": a, "end": b, "role": ROLES[got[at + a]]} for a, b in zip(cuts, cuts[1:], strict=False)])
                firsts.append(at)
                at += n
                ends.append(at)
            cols = [pa.array([r[0] for r in rows], kind), pa.array([r[2] for r in rows], to_arrow_type(turn_type)), pa.array([r[4] for r in rows], pa.string()), pa.array([ROLES[got[k]] for k in firsts])]
            cols += [pa.array([turned[k] for k in firsts]), pa.array([turned[k] for k in ends]), pa.array(parts, PARTS)]
            yield pa.RecordBatch.from_arrays(cols, [conv_col, turn_col, text_col, "role_pred", "opens", "closes", "parts"])

    schema = f"{conv_col} {conv_type.simpleString()}, {turn_col} {turn_type.simpleString()}, {text_col} string, role_pred string, opens boolean, closes boolean, parts array<struct<first:int,end:int,role:string>>"
    return sorted_(both.select("c", "g", "n", "t", "raw", "first", "before", "last", "after")).mapInArrow(decode, schema)


PARTS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("role", pa.string())]))


def _from_start(e: np.ndarray, into: list[np.ndarray]) -> np.ndarray:
    """Best sums of a transcript's first lines by the role of the last."""
    v = e[0]
    for x, t in zip(e[1:], into[1:], strict=True):
        v = (v[:, None] + t).max(0) + x
    return v


def _part_text(text_col: str, first, end):
    """The lines of a part, without the marker that its first line begins with."""
    mark = MARK.pattern.replace("^", "(?i)^", 1)
    lines = F.slice(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), first + 1, end - first)
    return F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, F.regexp_replace(x, F.lit(mark), F.lit(""))).otherwise(x)), "\n")


def canonical(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The messages of roles() with `rendered`, without speakers' markers: a part that opens a turn has its header, one that closes
    it the end mark, so the messages of a transcript joined by line ends are its canonical form."""
    last = F.size("parts") - 1

    def part(x, i):
        header = F.when((i > 0) | F.col("opens"), F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))).otherwise("")
        end = F.when((i < last) | F.col("closes"), "\n<|end|>").otherwise("")
        return F.concat(header, _part_text(text_col, x["first"], x["end"]), end)

    return found.withColumn("rendered", F.array_join(F.transform("parts", part), "\n"))


def turns(found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """A row for each part: conv_id, turn, part (from 0), role, text without its marker, and whether it begins a turn."""
    x = found.select(conv_col, turn_col, "opens", text_col, F.posexplode("parts").alias("part", "x"))
    own = _part_text(text_col, F.col("x.first"), F.col("x.end"))
    return x.select(conv_col, turn_col, "part", F.col("x.role").alias("role"), own.alias(text_col), ((F.col("part") > 0) | F.col("opens")).alias("begins"))

"""Secret scans by DataFrame functions only (operator 5).

Base kinds are regular expressions: `assign`, `access` and `hex`. The method adds `entropy_hex` (maximal runs of hex digits, also
inside longer strings), `entropy_text` and `entropy_case` (letters of one case and digits, as few symbols reach fewer bits):
over each candidate string of a character class a window slides, the counts of the class's characters change by the
character that comes and the one that goes, and the window's Shannon entropy follows from a running sum of c*log2(c),
kept in whole numbers so that it doesn't drift. A candidate with windows that reach the class's entropy is one span as a whole.
Candidates on the allow list (digits only, UUIDs, sample words between the first such window and the last) are left out.

All spans are in code points, end exclusive. Null and empty texts have none. Repeated rows are scanned each for itself,
columns with clashing names are replaced, an empty table gives an empty table. The cost is linear in the text; starts
are summed in blocks, so that a text with very many matches is no exception.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The base kinds in the order that ties follow: pattern, group, least length of the group.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
WINDOW = 24
#: Class: characters, candidate pattern, least bits of entropy in a window.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}", 3.0),
    "entropy_text": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", r"(?<![0-9A-Za-z+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9A-Fa-f]*[G-Zg-z+/_=-])[A-Za-z0-9+/_=-]{24,}", 3.9),
    "entropy_case": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r"(?<![0-9A-Za-z])(?:(?=[A-Z]*[0-9])(?=[0-9A-F]*[G-Z])[A-Z0-9]{24,}|(?=[a-z]*[0-9])(?=[0-9a-f]*[g-z])[a-z0-9]{24,})(?![0-9A-Za-z])", 3.5),
}
#: Shapes of a whole candidate, words of its hot part.
ALLOW_SHAPES = r"(?i)^[0-9]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOW_WORDS = r"(?i)example|placeholder|sample|dummy|changeme"
ALLOW = f"{ALLOW_SHAPES}|{ALLOW_WORDS.removeprefix('(?i)')}"
KINDS = [*BASE, *CLASSES]
SCALE = 1 << 24
#: c*log2(c) for each count, and the greatest sum that a window of a given entropy may have.
C_LOG_C = [round(SCALE * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def most(bits: float) -> int:
    return round(SCALE * WINDOW * (math.log2(WINDOW) - bits))


def _q(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _starts(d: str) -> str:
    """Running sums of the array d, by blocks."""
    inner = f"aggregate(slice({d}, k * 256 + 1, 256), named_struct('p', A.p, 'o', cast(array() as array<int>)), (a, x) -> named_struct('p', a.p + x, 'o', concat(a.o, array(a.p + x))))"
    return f"flatten(aggregate(sequence(0, (size({d}) - 1) div 256), named_struct('p', 0, 'o', cast(array() as array<array<int>>)), (A, k) -> transform(array({inner}), r -> named_struct('p', r.p, 'o', concat(A.o, array(r.o))))[0]).o)"


def _found(col: str, pattern: str, group: int) -> str:
    """Matches of a pattern, leftmost and not overlapping: array of (s, e, g), g being the group's text."""
    p = _q(pattern)
    deltas = "transform(z.gap, (x, i) -> length(x) + if(i = 0, 0, length(z.hit[i - 1])))"
    rows = f"transform(array(named_struct('hit', z.hit, 'got', z.got, 'at', {_starts('d')})), y -> transform(y.hit, (x, i) -> named_struct('s', y.at[i], 'e', y.at[i] + length(x), 'g', y.got[i])))[0]"
    return (
        f"CASE WHEN {col} RLIKE {p} THEN transform(array(named_struct('hit', regexp_extract_all({col}, {p}, 0), 'got', regexp_extract_all({col}, {p}, {group}), 'gap', split({col}, {p}, -1))), "
        f"z -> transform(array({deltas}), d -> {rows})[0])[0] ELSE cast(array() as array<struct<s:int,e:int,g:string>>) END"
    )


def _hot(s: str, letters: str, bits: float) -> str:
    """The first and the last end of the windows of string s that reach the entropy: struct of a, b; a is -1 if none."""
    f = "array(" + ", ".join(f"{x}L" for x in C_LOG_C) + ")"
    gone = f"if(i >= {WINDOW}, c[i - {WINDOW}], 0)"
    step = (
        "named_struct("
        f"'n', if(i < size(c), transform(w.n, (v, j) -> v + if(j = c[i], 1, 0) - if(j = {gone} and j > 0, 1, 0)), w.n), "
        f"'s', if(i < size(c) and c[i] <> {gone}, w.s + t[w.n[c[i]] + 1] - t[w.n[c[i]]] + if({gone} > 0, t[w.n[{gone}] - 1] - t[w.n[{gone}]], 0L), w.s), "
        f"'a', if(w.a < 0 and i >= {WINDOW} and w.s <= {most(bits)}L, i - {WINDOW}, w.a), "
        f"'b', if(i >= {WINDOW} and w.s <= {most(bits)}L, i, w.b))"
    )
    begin = f"named_struct('n', array_repeat(0, {len(letters) + 1}), 's', 0L, 'a', -1, 'b', -1)"
    codes = f"transform(filter(split({s}, ''), x -> x <> ''), x -> instr('{letters}', x))"
    # the window before step i ends at i, so a last step looks at the last window
    return f"transform(array({f}), t -> transform(array({codes}), c -> aggregate(sequence(0, size(c)), {begin}, (w, i) -> {step}))[0])[0]"


def scan(df: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """df with an array of (s, k, e): start, number of the kind in KINDS, end; in this order."""
    tmp = unused(df, "__t")
    df = df.withColumn(tmp, F.coalesce(F.col(text_col), F.lit("")))
    made = []
    for k, (pattern, group, least) in enumerate(BASE.values()):
        made.append(f"transform(filter({_found(tmp, pattern, group)}, m -> length(m.g) >= {least}), m -> named_struct('s', m.s, 'k', {k}, 'e', m.e))")
    for k, (letters, pattern, bits) in enumerate(CLASSES.values(), len(BASE)):
        hits = f"transform(filter({_found(tmp, pattern, 0)}, m -> NOT m.g RLIKE {_q(ALLOW_SHAPES)}), m -> named_struct('s', m.s, 'e', m.e, 'g', m.g, 'h', {_hot('m.g', letters, bits)}))"
        hot = "substring(m.g, m.h.a + 1, m.h.b - m.h.a)"
        made.append(f"transform(filter({hits}, m -> m.h.a >= 0 AND NOT {hot} RLIKE {_q(ALLOW_WORDS)}), m -> named_struct('s', m.s, 'k', {k}, 'e', m.e))")
    return df.withColumn(out_col, F.expr(f"array_sort(concat({', '.join(made)}))")).drop(tmp)


def joined(spans: str, base_only: bool) -> str:
    """SQL for kind:start:end, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    kept = f"filter({spans}, x -> x.k < {len(BASE)})" if base_only else spans
    return f"array_join(transform({kept}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each span of a text replaced by a mark; overlapping spans count as one. Texts without spans, null ones
    too, stay as they are."""
    found, t = unused(df, "__spans"), unused(df, "__text")
    spans = scan(df, text_col, found)
    # spans come by start: what a span adds is what lies beyond the end so far
    piece = "named_struct('o', concat(a.o, if(x.s >= a.e, array(substring({t}, a.e + 1, x.s - a.e), '{m}'), cast(array() as array<string>))), 'e', greatest(a.e, x.e))".format(t=t, m=mark.replace("'", r"\'"))
    out = f"CASE WHEN size({found}) = 0 THEN {text_col} ELSE transform(array(aggregate({found}, named_struct('o', cast(array() as array<string>), 'e', 0), (a, x) -> {piece})), r -> concat(array_join(r.o, ''), substring({t}, r.e + 1)))[0] END"
    return spans.withColumn(t, F.col(text_col)).withColumn(text_col, F.expr(out)).drop(found, t)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of each document's spans."""
    s = scan(df.select(id_col, text_col), text_col, "spans_of")
    count = lambda k: F.expr(f"cast(size(filter(spans_of, x -> x.k = {k})) as bigint)")
    return s.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(joined("spans_of", True)), 256).alias("base_sha256"), F.expr(joined("spans_of", False)).alias("spans"),
    )

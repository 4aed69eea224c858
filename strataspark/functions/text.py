"""String functions with the semantics of Python's, as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it.
_WS = r"[\s\x1c-\x1f]"


def blank(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def py_strip(c: Column | str) -> Column:
    """str.strip: all Unicode white space, not just spaces."""
    return F.regexp_replace(blank(c), f"(?U)^{_WS}+|{_WS}+$", "")


def or_else(*cols: Column) -> Column:
    """The first value that isn't blank, else the empty string."""
    return F.coalesce(*[F.nullif(blank(c), F.lit("")) for c in cols], F.lit(""))


def last_segment(url: Column | str) -> Column:
    """What follows the last slash, trailing slashes ignored."""
    return F.element_at(F.split(F.regexp_replace(blank(url), "/+$", ""), "/"), -1)


def safe_component(c: Column | str, default: str = "item") -> Column:
    """Runs of other characters than letters, digits, dot, dash and underscore become an underscore."""
    made = F.regexp_replace(F.regexp_replace(blank(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(made == "", F.lit(default)).otherwise(made)


def safe_name(c: Column | str, default: str = "item") -> Column:
    """The variant that keeps letters and digits of all scripts and strips underscores only."""
    made = F.regexp_replace(F.regexp_replace(blank(c), r"(?U)[^\p{L}\p{N}._-]", "_"), r"^_+|_+$", "")
    return F.when(made == "", F.lit(default)).otherwise(made)


def percent_encode(c: Column | str, keep: str = "") -> Column:
    """urllib's quote: spaces as %20, and the characters in `keep` as they are."""
    out = F.replace(F.replace(F.replace(F.url_encode(blank(c)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for ch in keep:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def wiki_url(lang: Column, title: Column) -> Column:
    """An article's address: spaces as underscores, and `_()` as they are."""
    t = py_strip(title)
    return F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), percent_encode(F.replace(t, F.lit(" "), F.lit("_")), "_()")))


def export_url(lang: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/Special:Export/"), percent_encode(title))


def recording_url(recording_id: Column) -> Column:
    return F.concat(F.lit("https://xeno-canto.org/"), recording_id, F.lit("/download"))


def file_type(url: Column, target: Column, default: str = "mp3") -> Column:
    """The suffix of a URL's path, else of the target, in lower case without the dot."""
    suffix = lambda c: F.nullif(F.lower(F.regexp_extract(blank(c), r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    return F.coalesce(suffix(F.regexp_replace(blank(url), r"[?#].*$", "")), suffix(target), F.lit(default))


def first_id_part(path: Column | str, pattern: str = r"^Q[0-9]+$") -> Column:
    """The first part of a relative path that is an id, else the parent folder's name, else `unknown`."""
    parts = F.split(blank(path), "/")
    hit = F.get(F.filter(parts, lambda x: x.rlike(pattern)), 0)
    parent = F.when(F.size(parts) >= 2, F.nullif(F.element_at(parts, -2), F.lit("")))
    return F.coalesce(hit, parent, F.lit("unknown"))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(last_segment(path), r"(?<=.)\.[^.]*$", "")


def audio_id(qid: Column, relative: Column | str) -> Column:
    """Id and file path without suffix, made safe; a leading id part isn't repeated."""
    rel = F.regexp_replace(blank(relative), r"(?<=[^/])\.[^./]*$", "")
    rest = F.when(F.startswith(rel, F.concat(qid, F.lit("/"))), F.substring(rel, F.length(qid) + 2, F.length(rel))).otherwise(rel)
    return F.concat_ws("_", qid, safe_component(rest))


def rank_name(c: Column | str) -> Column:
    return F.replace(F.lower(py_strip(c)), F.lit("_"), F.lit(" "))


def strip_nested(c: Column, start: str, end: str) -> Column:
    """Removes from each start token to the next end token; so `{{a{{b}}c}}` leaves `c}}`."""
    q = lambda s: "".join("\\" + ch for ch in s)
    return F.regexp_replace(c, f"(?s){q(start)}.*?{q(end)}", "")


#: The ordered substitutions that take wiki markup to plain text (pattern, replacement).
WIKI_STEPS = [
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)<ref[^>]*>.*?</ref>", " "),
    (r"<[^>]+>", " "),
    (r"(?iu)\[\[(?:File|Image|ファイル|画像):[^\]]+\]\]", " "),
    (r"(?iu)\[\[(?:Category|カテゴリ):[^\]]+\]\]", " "),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\[https?://[^\s\]]+(?U:\s)([^\]]+)\]", "$1"),
    (r"https?://(?U:\S+)", " "),
    (r"(?md)^=+(?U:\s*)(.*?)(?U:\s*)=+$", "$1"),
    (r"(?md)^\*.*$", " "),
    (r"(?md)^#.*$", " "),
    (r"(?md)^[;:].*$", " "),
    (r"\n{2,}", "\n"),
    (r"[ \t]+", " "),
]


def wiki_text(c: Column | str) -> Column:
    """Wiki markup as plain text."""
    out = strip_nested(strip_nested(blank(c), "{{", "}}"), "{|", "|}")
    for pattern, to in WIKI_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return py_strip(F.replace(F.replace(out, F.lit("'''"), F.lit("")), F.lit("''"), F.lit("")))


def markup_text(c: Column | str) -> Column:
    """Tags, scripts and styles of a page become spaces, runs of white space one space."""
    out = F.regexp_replace(blank(c), r"(?si)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " "), r"[ \t\r\n]+", " "))


def sentences(c: Column | str, least: int = 20) -> Column:
    """The sentences of at least `least` characters: ends are a full stop and the like before white space, or line ends."""
    cut = F.split(blank(c), r"(?<=[。．！？.!?])(?U:\s+)|\n+")
    return F.filter(F.transform(cut, lambda x: py_strip(x)), lambda x: F.length(x) >= least)


def fixed(c: Column, digits: int) -> Column:
    """A number as text with so many decimals."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def grey(name: Column) -> Column:
    """A grey that follows from a name: 80 + the first four bytes of its SHA-1 modulo 70, three times as hexadecimal."""
    n = F.conv(F.substring(F.sha1(F.lower(name)), 1, 8), 16, 10).cast("bigint")
    h = F.lpad(F.lower(F.hex(F.lit(80) + n % 70)), 2, "0")
    return F.concat(F.lit("#"), h, h, h)


def gradient(position: Column, start: tuple[int, int, int], end: tuple[int, int, int]) -> Column:
    """A colour between two, channels rounded half to even."""
    part = [F.lpad(F.lower(F.hex(F.bround(F.lit(float(a)) + (b - a) * position).cast("bigint"))), 2, "0") for a, b in zip(start, end, strict=True)]
    return F.concat(F.lit("#"), *part)


def alias_list(c: Column | str) -> Column:
    """A JSON array of strings as such; other text that isn't blank as its one element."""
    parsed = F.from_json(blank(c), "array<string>")
    got = F.when(blank(c) == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(blank(c))))
    return F.filter(F.transform(got, lambda x: py_strip(x)), lambda x: x != "")


# ---- addresses, kinds and details


def recording_page(recording_id: Column) -> Column:
    return F.concat(F.lit("https://xeno-canto.org/"), recording_id)


def api_query(species: Column, quality: Column) -> Column:
    """A search by species (dashes as spaces), and by quality unless that is blank."""
    q = F.upper(py_strip(quality))
    return F.concat(F.lit('sp:"'), py_strip(F.replace(blank(species), F.lit("-"), F.lit(" "))), F.lit('"'), F.when(q == "", "").otherwise(F.concat(F.lit(" q:"), q)))


def api_url(species: Column, quality: Column, page: Column, per_page: int, key: str) -> Column:
    return F.concat(F.lit("https://xeno-canto.org/api/3/recordings?query="), percent_encode(api_query(species, quality)), F.lit("&page="), page.cast("string"), F.lit(f"&per_page={per_page}&key="), percent_encode(F.lit(key)))


def codec_args(kind: Column) -> Column:
    """What an audio encoder is asked for, by type of file; others are copied."""
    k = F.lower(py_strip(kind))
    args = lambda *a: F.array(*map(F.lit, a))
    return F.when(k == "mp3", args("-c:a", "libmp3lame", "-q:a", "2")).when(k == "wav", args("-c:a", "pcm_s16le")).otherwise(args("-c:a", "copy"))


def rank_key(rank: Column, name: Column) -> Column:
    """What a rank is coloured by: its id, else its name in lower case, else `other`."""
    return or_else(py_strip(rank), F.lower(py_strip(name)), F.lit("other"))


def rank_title(rank: Column, name: Column, titles: dict[str, str]) -> Column:
    """What a rank is called: by its id (the id itself, if that has no title), else by its name."""
    known = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    own = py_strip(rank)
    return F.when(own != "", F.coalesce(F.try_element_at(known, own), own)).otherwise(or_else(py_strip(name), F.lit("other / missing")))


def details(qid: Column, label: Column, rank_name: Column, rank: Column, taxon: Column, entity_url: Column, wiki_url_: Column) -> Column:
    """A node's details, a line each; addresses only where there are some."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), blank(c))
    some = lambda name, c: F.when(blank(c) != "", line(name, c))
    return F.concat_ws("\n", line("QID", qid), line("English label", label), F.concat(line("Taxon rank", rank_name), F.lit(" ("), blank(rank), F.lit(")")), line("Taxon name", taxon), some("Wikidata", entity_url), some("English Wikipedia", wiki_url_))


def rgb(color: Column) -> Column:
    """The three channels of #RRGGBB."""
    return F.array(*[F.conv(F.substring(color, i, 2), 16, 10).cast("int") for i in (2, 4, 6)])


def gradient_over(anchors: list[str], index: Column, total: Column) -> Column:
    """The colour of a place among `total` along a list of colours, channels rounded half to even, in capitals."""
    at = F.when(total > 1, index * float(len(anchors) - 1) / (total - 1)).otherwise(0.0)
    left = F.least(F.floor(at).cast("int"), F.lit(len(anchors) - 1))
    colors = F.array(*[rgb(F.lit(a)) for a in anchors])
    a, b = F.get(colors, left), F.get(colors, F.least(left + 1, F.lit(len(anchors) - 1)))
    mixed = F.zip_with(a, b, lambda x, y: F.lpad(F.hex(F.bround(x + (y - x) * (at - left)).cast("bigint")), 2, "0"))
    return F.concat(F.lit("#"), F.array_join(mixed, ""))


def listed(values: list[str] | str, known: set[str], upper: bool = False) -> list[str]:
    """The items of comma-separated lists, each once, blank ones left out; items that aren't known are an error."""
    out: dict[str, None] = {}
    for v in [values] if isinstance(values, str) else values:
        for x in v.split(","):
            x = x.strip().upper() if upper else x.strip().lower()
            if x:
                out[x] = None
    if unknown := sorted(set(out) - known):
        raise ValueError("unknown: " + ", ".join(unknown))
    return list(out)


def setting(name: str, given: str | None, environment: dict[str, str], lines: list[str], default: str) -> str:
    """A setting as given, else from the environment, else from lines of NAME=value (`export` and quotes are allowed), else the default."""
    for x in (given, environment.get(name)):
        if x and x.strip():
            return x.strip()
    for line in lines:
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        value = value.strip().strip('"').strip("'")
        if eq and key.strip() == name and value:
            return value
    return default

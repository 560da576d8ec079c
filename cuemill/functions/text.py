"""Text columns: white space, tokens, subtitle lines, clock times and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space between words, and the marks that stand without a space before them.
WHITE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
CLOSING = r"^(?:[.,!?;:%)\]}…]|$)"
#: A word that ends a sentence.
TERMINAL = r"""[.!?…]["'”’)]*$"""
LINE = 42
_ASCII_SPACE = r"[\x09-\x0d\x20]"


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def collapse(text: Column) -> Column:
    """Words with one space between them."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def join_tokens(tokens: Column) -> Column:
    """Tokens with a space before each but the first and closing marks. Empty tokens take none either; a space stands
    only after something."""
    spaced = F.transform(tokens, lambda t, i: F.when((i == 0) | t.rlike(CLOSING), t).otherwise(F.concat(F.lit(" "), t)))
    joined = F.array_join(spaced, "")
    # Leading empty tokens leave nothing in front, so the first real token has no space either.
    return F.when(F.get(tokens, F.lit(0)) == "", F.regexp_replace(joined, "^ ", "")).otherwise(joined)


def ends_sentence(word: Column) -> Column:
    return word.rlike(TERMINAL)


def wrap_lines(text: Column, width: int = LINE) -> Column:
    """Greedy lines of at most width, words kept whole; a text of more than two lines is cut once, at the white space
    nearest to its middle (of two, the first)."""
    flat = F.regexp_replace(text, _ASCII_SPACE, " ")
    # Spaces at a line's end go; inner runs stay as they are. A chunk is a word or a run of spaces.
    chunks = F.regexp_extract_all(flat, F.lit(r" +|[^ ]+"), F.lit(0))
    start = F.struct(F.lit("").alias("line"), F.array().cast("array<string>").alias("lines"))

    def add(a: Column, c: Column) -> Column:
        blank = F.trim(c) == ""
        fits = F.length(a["line"]) + F.length(c) <= width
        fresh = F.length(a["line"]) == 0
        begun = F.size(a["lines"]) > 0
        on = F.struct(F.concat(a["line"], c).alias("line"), a["lines"].alias("lines"))
        shut = lambda line: F.struct(line.alias("line"), F.when(F.rtrim(a["line"]) != "", F.concat(a["lines"], F.array(F.rtrim(a["line"])))).otherwise(a["lines"]).alias("lines"))
        # A third line is enough to know.
        return F.when((F.size(a["lines"]) > 2) | fresh & begun & blank, a).when(fits | fresh, on).when(blank, shut(F.lit(""))).otherwise(shut(c))

    lines = F.aggregate(chunks, start, add, lambda a: F.when(F.rtrim(a["line"]) != "", F.concat(a["lines"], F.array(F.rtrim(a["line"])))).otherwise(a["lines"]))
    space, other = WHITE[:-1], "[^" + WHITE[1:-1]

    def halved(t: Column) -> Column:
        middle = F.floor(F.length(t) / 2).cast("int")
        # Runs of white space start where another letter ends: the last up to the middle, and the first after it.
        before, after = F.substring(t, F.lit(1), middle + 1), F.substring(t, middle + 1, F.length(t))
        left = F.when(before.rlike(space), F.length(F.regexp_extract(before, f"(?s)^(.*{other}|){space}+{other}*$", 1)))
        right = F.nullif(F.length(F.regexp_extract(after, f"^({space}*{other}+){space}", 1)), F.lit(0)) + middle
        nearest = F.when(left.isNull() | (right - middle < middle - left), right).otherwise(left)
        return bind(nearest, lambda at: F.when(at.isNull(), t).otherwise(F.concat(strip(F.substring(t, F.lit(1), at)), F.lit("\n"), strip(F.substring(t, at + 1, F.length(t))))))

    filled = bind(lines, lambda ls: F.when(F.size(ls) <= 2, F.array_join(ls, "\n")).otherwise(halved(text)))
    # Words that all fit, with single spaces: the first line is the longest one that leaves a second, if any does.
    plain = flat.rlike(rf"^[^ ]{{1,{width}}}( [^ ]{{1,{width}}})*+$")
    two = rf"(?s)^(.{{1,{width}}}) (.{{1,{width}}})$"
    return F.when(F.length(text) <= width, text).when(plain, F.when(flat.rlike(two), F.regexp_replace(flat, two, "$1\n$2")).otherwise(halved(text))).otherwise(filled)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def clock(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds after mark, rounded half up; hours grow without bound, negative times are zero."""
    ms = F.greatest(F.floor(seconds * 1000 + 0.5), F.lit(0)).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", *[x.cast("bigint") for x in (F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)])


def speaker_prefix(speaker: Column) -> Column:
    return F.coalesce(F.concat(F.lit("[Speaker "), speaker.cast("string"), F.lit("] ")), F.lit(""))


def speaker_label(speaker: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Speaker "), speaker.cast("string")), F.lit(""))


def safe_stem(name: Column) -> Column:
    """A file name's stem with letters, digits, _, - and . of any script; "media" if nothing is left."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w.-]+", "-"), r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("media"))


def upload_name(name: Column, index: Column) -> Column:
    """A stored upload: its number in three digits, then the safe name."""
    safe = F.regexp_replace(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?U)[^\w.-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.concat(F.format_string("%03d-", index), F.coalesce(F.nullif(safe, F.lit("")), F.lit("media")))


def display_name(name: Column, is_upload: Column) -> Column:
    return F.when(is_upload, F.regexp_replace(name, r"^[0-9]{3}-", "")).otherwise(name)


def bytes_label(size: Column) -> Column:
    """1024-based units with three digits or so: none after the point for bytes and from 100 on, one from 10 on, else two."""
    units = ("B", "KB", "MB", "GB", "TB")
    power = reduce(lambda a, k: F.when(size >= 1024.0**k, k).otherwise(a), range(1, len(units)), F.lit(0))
    value = size / F.pow(F.lit(1024.0), power)
    shown = F.when((power == 0) | (value >= 100), F.format_string("%.0f", value)).when(value >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
    return F.when(size.isNull() | F.isnan(size.cast("double")) | (size < 0) | (size.cast("double") == float("inf")), "\u2013").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*[F.lit(u) for u in units]), power + 1)))


def duration_label(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = seconds.cast("double")
    whole = F.floor(s).cast("bigint")
    hours, minutes, rest = F.floor(whole / 3600).cast("bigint"), F.floor(whole % 3600 / 60).cast("bigint"), whole % 60
    shown = F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))
    return F.when(s.isNull() | F.isnan(s) | (s < 0) | (s == float("inf")), "\u2013").otherwise(shown)


def percent_label(fraction: Column) -> Column:
    x = fraction.cast("double")
    clamped = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "\u2013").otherwise(F.concat(F.floor(clamped * 100 + 0.5).cast("string"), F.lit(" %")))


def plural(count: Column, singular: str, several: str | None = None) -> Column:
    return F.concat(count.cast("string"), F.when(count == 1, f" {singular}").otherwise(f" {several or singular + 's'}"))


#: Names of artifact kinds.
ARTIFACT_LABELS = {"txt": "Plain text", "srt": "SRT subtitles", "vtt": "WebVTT subtitles", "json": "JSON transcript"}


def artifact_label(name: Column) -> Column:
    """What an artifact's kind is called; others keep their names."""
    base = F.regexp_replace(name, r"^edited\.", "")
    known = F.coalesce(F.create_map(*[F.lit(x) for pair in ARTIFACT_LABELS.items() for x in pair])[base], name)
    return F.concat(known, F.when(name.startswith("edited."), " (edited)").otherwise(""))


def tail(text: Column, size: int) -> Column:
    """The last size characters."""
    return F.right(text, F.lit(size))


def first_line(text: Column) -> Column:
    """The first line that isn't blank."""
    return F.get(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != ""), F.lit(0))


def tool_version(stdout: Column, stderr: Column) -> Column:
    """The first line that a tool printed about itself."""
    said = F.coalesce(F.nullif(strip(F.coalesce(stdout, F.lit(""))), F.lit("")), F.nullif(strip(F.coalesce(stderr, F.lit(""))), F.lit("")))
    return F.coalesce(F.get(F.split(said, r"\r\n|\r|\n"), F.lit(0)), F.lit("unknown"))


def field_of(text: Column, name: str) -> Column:
    """The value of a "name: value" line."""
    return F.nullif(strip(F.regexp_extract(text, rf"(?m)^{name}:(.*)$", 1)), F.lit(""))


def linked_library(line: Column) -> Column:
    """name and absolute target of a "name => target (address)" line; target null where it isn't found."""
    name, target = strip(F.split(line, "=>", 2)[0]), strip(F.get(F.split(line, "=>", 2), F.lit(1)))
    path = strip(F.regexp_replace(target, r"\s*\(0x[0-9a-f]+\)$", ""))
    return F.when(line.contains("=>"), F.struct(name.alias("name"), F.when(path.startswith("/"), path).alias("target")))

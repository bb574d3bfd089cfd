"""Text functions: search predicates, normalisation, globs, truncation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("Critical", "Error", "Warning", "Info", "Debug", "Unknown")
TRUNCATED = "... [truncated]"

# What normalisation replaces, in this order.  Digits, word boundaries and case are those of Unicode (``U``), as in the reference.
NORMALISED = (
    (r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<GUID>"),
    (r"(?iU)\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}\b|::1\b", "<IP>"),
    (r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b", "<IP>"),
    (r"(?iU)\b0x[0-9a-f]{8,}\b", "<HEX>"),
    (r"(?U)\b\d+(\.\d+)?\b", "<NUM>"),
)
#: What a text must have one of, for each of these.
_NEEDS = (("-",), (":",), (".",), ("0x", "0X"), ())


def severity_rank(severity: Column) -> Column:
    """0 = Critical ... 5 = Unknown."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1, F.lit(5)).cast("tinyint")


def short_label(severity: Column) -> Column:
    return F.upper(F.substring(severity, 1, 4))


def prefix_sums(sizes: Column, block: int = 128) -> Column:
    """Array of the sums of the numbers before each place of ``sizes`` (longs).  Two levels, as a fold that appends copies what it has."""
    longs = "array<bigint>"

    def folded(values: Column, start: Column) -> Column:
        first = F.struct(start.cast("long").alias("at"), F.array().cast(longs).alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, first, step, lambda acc: acc["out"])

    blocks = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(block))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(blocks, lambda i: F.slice(sizes, i, F.lit(block)))
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(parts, folded(sums, F.lit(0)), folded))


def _one_argument(step):
    return lambda text: step(text)


def normalize_message(message: Column) -> Column:
    """Variable parts replaced by marks, so that messages that differ only in those are equal.

    A replacement runs only where the text has what its pattern can't do without.  Each step is a lambda's body, so that its text is worked out once.
    """
    for (pattern, mark), need in zip(NORMALISED, _NEEDS, strict=True):

        def step(text: Column, pattern=pattern, mark=mark, need=need) -> Column:
            replaced = F.regexp_replace(text, pattern, mark)
            return F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in need)), replaced).otherwise(text) if need else replaced

        message = F.get(F.transform(F.array(message), _one_argument(step)), F.lit(0)) if need else step(message)
    return message


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive substring test; null is no match."""
    return F.coalesce(F.contains(F.lower(text), F.lower(F.lit(needle))), F.lit(False))


def java_escape(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-&~#\s])", r"\\\1", text)


def fuzzy(text: Column, query: str) -> Column:
    """The characters of ``query`` appear in order, whatever lies between."""
    return F.coalesce(text.rlike("(?isu)" + ".*?".join(java_escape(c) for c in query)), F.lit(False))


def glob_regex(glob: str) -> str:
    """``* ? [..]`` glob -> anchored Java expression; ``*`` also crosses ``/``, ``[!..]`` negates."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close]
            out += "[" + ("^" + java_escape(body[1:]).replace(r"\-", "-") if body[0] == "!" else java_escape(body).replace(r"\-", "-")) + "]"
            i = close
        else:
            out += java_escape(c)
        i += 1
    return f"(?s)^{out}\\z"


def matches_glob(name: Column, globs: list[str], ignore_case: bool = False) -> Column:
    if not globs:
        return F.lit(False)
    fold = (lambda g: g.lower()) if ignore_case else (lambda g: g)
    return (F.lower(name) if ignore_case else name).rlike("|".join(f"(?:{glob_regex(fold(g))})" for g in globs))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def decode_entities(text: Column) -> Column:
    """The five XML entities, ``&amp;`` last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_bytes(text: Column, most: int) -> Column:
    """At most ``most`` UTF-8 bytes, cut at a character, with a mark if cut."""
    head = F.substring(text.cast("binary"), 1, most)
    # A cut inside a character leaves its first bytes: drop the invalid tail.
    clean = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�+\\z", "")
    return F.when(F.octet_length(text) > most, F.concat(clean, F.lit(TRUNCATED))).otherwise(text)


def preview(message: Column, most: int = 140) -> Column:
    """First line, control characters (but tab) replaced, cut with an ellipsis."""
    line = F.regexp_replace(F.split(message, "\n")[0], r"[\p{Cc}&&[^\t]]", "�")
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def format_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def rfc3339(ts: Column) -> Column:
    """RFC 3339 with the fraction only if there is one."""
    fraction = F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.000000$", "")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))

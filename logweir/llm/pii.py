"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts; DataFrame functions only.

Base entities of four kinds come from regular expressions, leftmost and non-overlapping per kind; a match that fails its
check (value range, digit count, Luhn sum) is dropped without a second try.

Bootstrap.  Occurrences are base entities and candidates, runs of ``LENGTH`` or more letters, digits, ``_`` and ``-`` with a digit,
outside of base entities.  Seeds are the base entities and candidates that an assignment names (``token = "..."``, :data:`CUES`).
The patterns of an occurrence are
* ``L``: the two words before it, with what is stuck to it on the left;
* ``B``: the words on either side, with what is stuck to it;
* ``S``: its shape, for candidates that are numbers or have ``LONG`` characters: kinds of characters and length.
In the bipartite graph of patterns and values
    confidence(pattern) = sum of its values' scores / (number of its values with a score above 0 + 1), over all values for a number's shape
    score(value) = 1 - product over its strong patterns of (1 - confidence);  seeds keep 1
are iterated ``ROUNDS`` times.  Values of which nothing is known yet are no errors of a pattern, but for numbers of some length, which are
alike by chance.  A pattern is strong with ``STRONG`` confidence and ``SUPPORT`` values of score ``STRONG``.  A candidate
occurrence in a strong pattern is an ``id`` span; so seeds of assignments are as soon as their pattern is strong.

Spans count code points, end exclusive.  The expressions are written so that every character is looked at a bounded
number of times, runs without a match included, and never recurse on long runs.  Words of contexts are whole words: where
the ``CONTEXT`` characters around a span don't hold them, all of the text does.

Defined cases: null text is empty; empty texts have no spans; an empty table gives none; rows are independent of each other but for the
graph, where equal values count once per pattern, so that repeated rows and ties change nothing; repeated rows get equal results; very
long texts count in full; input columns but ``text`` come back in ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix_sums
from .common import materialize

KINDS = ("email", "ip", "card", "phone", "id")
LENGTH, LONG, ROUNDS, STRONG, SUPPORT, CONTEXT = 4, 16, 3, 0.8, 3, 60
# Names of what must not be seen.
CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "client_secret", "credential", "ssn", "passport", "iban")
_CUE = r"(?i)(?:^|[^a-z])(?:" + "|".join(CUES) + r")s?[\"']?\s*[:=]\s*[\"']?\z"

# The base patterns.  A run that fails from its first character fails from any other, so matches start at
# the start of a run or where the last match ended (\G).
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any match passes.
_MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_CANDIDATE = r"(?<![0-9A-Za-z_-])[A-Za-z_-]*+[0-9][0-9A-Za-z_-]*+"


def found(text: Column, pattern: str, maybe: str) -> Column:
    """Matches of ``pattern`` as (start, end, value), in order: what splits the text says where each match stands."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    both = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: (F.char_length(g) + F.char_length(v)).cast("long"))

    def span(v: Column, before: Column, gap: Column) -> Column:
        start = before + F.char_length(gap)
        return F.struct(start.alias("start"), (start + F.char_length(v)).alias("end"), v.alias("value"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    zipped = F.arrays_zip(values.alias("v"), prefix_sums(both).alias("b"), F.slice(gaps, 1, F.size(values)).alias("g"))
    walked = F.transform(zipped, lambda z: span(z["v"], z["b"], z["g"]))
    hit = F.contains(text, F.lit(maybe)) if len(maybe) == 1 else F.regexp(text, F.lit(maybe))
    return F.when(hit & (F.size(values) > 0), walked).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": F.regexp(value, F.lit(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")),
        "card": n.between(16, 19) & F.when(n.between(16, 19), _luhn(value)).otherwise(False),
        "phone": n.between(8, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """All base entities: (order, kind, start, end, value), by kind as in ``KINDS``, then start."""

    def of(order: int, kind: str) -> Column:
        valid = F.filter(found(text, PATTERNS[kind], _MAYBE[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(valid, lambda s: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS[:4])])


def shape(value: Column) -> Column:
    """Kinds of characters and length: ``digits 12``, ``hex 40``, ``mixed 24``; short values of letters and digits have none."""
    n = F.char_length(value)
    kind = F.when(value.rlike("^[0-9]+$"), "digits").when(n >= LONG, F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").otherwise("mixed"))
    return F.concat_ws(" ", kind, F.when(kind.isNotNull(), n.cast("string")))


def surroundings(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """What stands before and after a span, at least its two words before and the next behind, in whole."""
    left = lambda k: F.substring(text, F.greatest(start - k, F.lit(0)) + 1, F.least(start, F.lit(k)))
    right = F.substring(text, end + 1, F.lit(CONTEXT))
    whole_left = (start <= CONTEXT) | left(CONTEXT).rlike(r"\s\S+\s+\S+\s+\S*\z")
    whole_right = (F.char_length(right) < CONTEXT) | right.rlike(r"^\S*\s+\S+\s")
    before = F.when(whole_left, left(CONTEXT)).otherwise(F.substring(text, F.lit(1), start))
    after = F.when(whole_right, right).otherwise(F.substring(text, end + 1, F.char_length(text)))
    return F.lower(before), F.lower(after)


def contexts(before: Column, after: Column, value: Column | None = None) -> Column:
    """The patterns of a span; ``value`` adds its shape."""
    glue = r"([^\s\w]*)\z"
    stuck, stuck_after = F.regexp_extract(before, glue, 1), F.regexp_extract(after, r"^([^\s\w]*)", 1)
    words = F.regexp_replace(before, r"\s*[^\s\w]*\z", "")
    two, one = F.regexp_extract(words, r"(\S+\s+\S+)\z", 1), F.regexp_extract(words, r"(\S+)\z", 1)
    next_ = F.regexp_extract(after, r"^[^\s\w]*\s*(\S+)", 1)
    found = [
        F.when(two != "", F.concat(F.lit("L "), F.regexp_replace(two, r"\s+", " "), F.lit(" "), stuck)),
        F.when((one != "") & (next_ != ""), F.concat(F.lit("B "), one, F.lit(" "), stuck, F.lit("_"), stuck_after, F.lit(" "), next_)),
    ]
    if value is not None:
        found.append(F.when(shape(value) != "", F.concat(F.lit("S "), shape(value))))
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def occurrences(docs: DataFrame) -> DataFrame:
    """``rid, row, base, candidates`` for every row of ``docs(text, ...)``, written to shared storage."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text.alias("text"))
    rows = rows.select("row", "text", base_spans(F.col("text")).alias("base"), found(F.col("text"), _CANDIDATE, r"[0-9]").alias("runs"))

    def outside(s: Column) -> Column:
        return (F.char_length(s["value"]) >= LENGTH) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def seen(s: Column, candidate: bool) -> Column:
        before, after = surroundings(F.col("text"), s["start"].cast("int"), s["end"].cast("int"))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.md5(s["value"].cast("binary")).alias("value"),
            (before.rlike(_CUE) if candidate else F.lit(True)).alias("seed"), contexts(before, after, s["value"] if candidate else None).alias("patterns"),
        )

    out = rows.select(
        F.monotonically_increasing_id().alias("rid"), "row", F.transform("base", lambda b: F.struct(b["order"].alias("order"), b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))).alias("base"),
        F.transform("base", lambda s: seen(s, False)).alias("seeds"), F.transform(F.filter("runs", outside), lambda s: seen(s, True)).alias("candidates"),
    )
    return materialize(out, "entities")


def strong_patterns(seen: DataFrame, rounds: int = ROUNDS, strong: float = STRONG, support: int = SUPPORT) -> DataFrame:
    """``pattern, confidence`` of the strong patterns, from :func:`occurrences`."""
    each = seen.select(F.explode(F.concat("seeds", "candidates")).alias("s"))
    edges = each.select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.col("s.seed").cast("double").alias("seed"))
    edges = materialize(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    values = edges.groupBy("value").agg(F.max("seed").alias("score"))
    high = None
    for _ in range(rounds):
        values = materialize(values, "values")
        n, total = F.count_if((F.col("score") > 0) | F.startswith("pattern", F.lit("S digits"))), F.sum("score")
        high = materialize(
            edges.join(values, "value").groupBy("pattern")
            .agg((total / (n + 1)).alias("confidence"), F.count_if(F.col("score") >= strong).alias("good"))
            .where((F.col("confidence") >= strong) & (F.col("good") >= support)).select("pattern", "confidence"),
            "patterns",
        )
        miss = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        values = edges.join(high, "pattern", "left").groupBy("value").agg(F.greatest(F.max("seed"), 1 - F.coalesce(miss, F.lit(1.0))).alias("score"))
    return high


def entities(docs: DataFrame) -> DataFrame:
    """``row, base, spans`` for every row of ``docs(text, ...)``: base entities, and all entities with those of kind ``id``."""
    seen = occurrences(docs)
    strong = strong_patterns(seen)
    at = seen.select("rid", F.explode("candidates").alias("c")).select("rid", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    taken = at.join(strong, "pattern", "left_semi").select("rid", "start", "end").distinct()
    more = taken.groupBy("rid").agg(F.collect_list(F.struct(F.lit(4).alias("order"), F.lit("id").alias("kind"), "start", "end")).alias("more"))
    spans = F.concat("base", F.coalesce("more", F.array().cast("array<struct<order:int,kind:string,start:bigint,end:bigint>>")))
    return seen.join(more, "rid", "left").select("row", "base", F.array_sort(spans).alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""URL filters: rules indexed by their rarest literal token; DataFrame functions only.

Two kinds of rule:
* a site rule ``host/path``: fits the host and all its subdomains if the url's path starts with the rule's.
  The longest site rule that fits decides;
* a pattern rule: a regular expression over ``host + path`` with the literal tokens that any match has
  (words of the host, or globs such as ``*/ads/*.gif``).  It decides where no site rule fits; block wins over allow.

A token is a run of 0-9 and a-z (A-Z lower-cased) that stands alone between other characters.  One pass counts the
rules' tokens over the distinct urls; each rule is indexed under its rarest token.  The tokens of a url
fetch the candidate rules (a join on the token), only candidates run their expression.
A rule without literal token is a candidate for every url.

Rules are a tuple of :class:`Rule` or a table of any size (:func:`read_rules`); up to ``BROADCAST_RULES`` of them the index is broadcast.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; the default verdict
then holds.  Repeated urls are judged once and joined back, so repeated rows get equal verdicts; very long urls are whole; rules that tie
in length are told apart by block before allow, then by name; an empty table gives none.  Other columns pass through in ``row``, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant_table, materialize

ALLOW, BLOCK = "allow", "block"
#: Up to this many rules the index is broadcast (a rule is some hundred bytes); beyond it's a shuffled join.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool


def quoted(text: str) -> str:
    """``text`` as an expression for itself."""
    return rf"\Q{text.replace(r'\E', r'\E\\E\Q')}\E"


def site_rule(name: str, verdict: str) -> Rule:
    """``example.com/en/7``: host up to the first ``/``, in any case, path from it; a host alone fits all its paths."""
    host, slash, rest = name.partition("/")
    host, path = host.translate(str.maketrans(_UPPER, _LOWER)), slash + rest
    # The path is a prefix: its last token may go on in the url unless something else follows it.
    tokens = re.findall(r"[0-9a-z]+", host) + re.findall(r"[0-9a-z]+(?=[^0-9a-z])", path.lower())
    end = quoted(path) if path else r"(?:/|\z)"
    return Rule(name, verdict, rf"^(?:[^/?#]*\.)?{quoted(host)}{end}", tuple(tokens), True)


def glob_rule(glob: str, verdict: str = BLOCK) -> Rule:
    """``*/ads/*.gif`` over host and path, lower case; ``*`` is any run of characters."""
    parts = glob.lower().split("*")
    tokens = re.findall(r"(?<![0-9a-z*])[0-9a-z]+(?![0-9a-z*])", glob.lower())  # one that touches a star may go on in the url
    return Rule(glob, verdict, "(?i)^" + ".*".join(quoted(p) if p else "" for p in parts) + r"\z", tuple(dict.fromkeys(tokens)), False)


def word_rule(word: str, verdict: str = BLOCK) -> Rule:
    """A word of the host, in any case, with no letter or digit beside it; it is found by the tokens that it has."""
    low = word.translate(str.maketrans(_UPPER, _LOWER))
    return Rule(word, verdict, rf"^(?:[^/]*[^0-9a-z/])?{quoted(low)}(?:[^0-9a-z]|$)", tuple(dict.fromkeys(re.findall(r"[0-9a-z]+", low))), False)


#: The site rules of the contract, and words of hosts that crawls leave out.
SITE_RULES = (
    site_rule("com/en/", BLOCK), site_rule("example.com/en/7", ALLOW), site_rule("net/de/", ALLOW),
    site_rule("example.net/de/8", BLOCK), site_rule("org/es/", BLOCK),
)
WORDS = ("adult", "ads", "bets", "betting", "casino", "escort", "gambling", "lottery", "pills", "poker", "porn", "spam", "viagra", "xxx")
RULES = SITE_RULES + tuple(word_rule(w) for w in WORDS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, parts, k), F.lit(""))
    return F.translate(get(1), _UPPER, _LOWER), get(2)


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(F.concat(host, path), _UPPER, _LOWER), "[^0-9a-z]+"), lambda t: t != ""))


RULE = "name string, says string, regex string, site boolean, length int, tokens array<string>"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return constant_table(spark, [(r.name, r.verdict, r.regex, r.site, len(r.name), list(r.tokens)) for r in rules], RULE)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from text files: a line is ``block`` or ``allow``, a space, and ``host/path``, a glob with ``*``, or ``=word`` of a host.

    From ``#`` on a line is a comment; empty lines mean nothing; any other line is an error that names it.  The table can have any size;
    :func:`site_rule` and the others say what a rule means.
    """
    line = F.trim(F.regexp_replace(F.regexp_replace("value", r"#.*", ""), r"\s+", " "))
    right = line.rlike(r"^(?i:block|allow) =?[^ ]*[^ =][^ ]*$")
    says = F.when(right, F.lower(F.regexp_extract(line, r"^(\S+)", 1))).otherwise(F.raise_error(F.concat(F.lit("no rule: "), "value")).cast("string"))
    raw = spark.read.text(path).where(line != "").select(says.alias("says"), F.regexp_extract(line, r"(\S+)$", 1).alias("name")).distinct()
    lowered = F.translate("name", _UPPER, _LOWER)
    word, glob = F.startswith("name", F.lit("=")), F.contains("name", F.lit("*"))
    host, tail = F.translate(F.regexp_extract("name", "^([^/]*)", 1), _UPPER, _LOWER), F.regexp_extract("name", "^[^/]*(.*)$", 1)
    safe = lambda c: F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    quote = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    any_ = F.regexp_replace(safe(lowered), r"\*+", "\\\\E.*\\\\Q")
    token = F.substring(lowered, 2, 1 << 20)
    regex = (
        F.when(word, F.concat(F.lit("^(?:[^/]*[^0-9a-z/])?"), quote(safe(token)), F.lit("(?:[^0-9a-z]|$)")))
        .when(glob, F.concat(F.lit("(?i)^"), quote(any_), F.lit(r"\z")))
        .otherwise(F.concat(F.lit(r"^(?:[^/?#]*\.)?"), quote(safe(host)), F.when(tail != "", quote(safe(tail))).otherwise(F.lit(r"(?:/|\z)"))))
    )
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    tokens = (
        F.when(word, F.array_distinct(found(token, "[0-9a-z]+")))
        .when(glob, found(lowered, r"(?<![0-9a-z*])[0-9a-z]+(?![0-9a-z*])"))
        .otherwise(F.concat(found(host, "[0-9a-z]+"), found(F.lower(tail), "[0-9a-z]+(?=[^0-9a-z])")))
    )
    return raw.select("name", "says", regex.alias("regex"), (~word & ~glob).alias("site"), F.char_length("name").alias("length"), tokens.alias("tokens"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, default: str = ALLOW) -> DataFrame:
    """``row, host, path, rule, pattern, verdict`` for every row of ``pages(url, ...)``: the site rule that decides, else
    the pattern rule; ``row`` has the page's columns but ``html``, whose text no rule reads."""
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    size = table.count() if isinstance(rules, DataFrame) else len(rules)
    hint = F.broadcast if size <= BROADCAST_RULES else (lambda df: df)
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "html"]).alias("row"), host.alias("host"), path.alias("path"))
    sites = rows.select("host", "path").distinct()
    probes = sites.select("host", "path", F.explode(F.concat(tokens_of(F.col("host"), F.col("path")), F.array(F.lit("")))).alias("token"))
    names = table.select(F.explode("tokens").alias("token")).distinct()
    counts = probes.join(hint(names), "token").groupBy("token").count()
    each = table.select("name", "says", "regex", "site", "length", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token"))
    index = materialize(each.groupBy("name", "says", "regex", "site", "length").agg(F.coalesce(rarest, F.lit("")).alias("token")), "rules")
    # Site before pattern, longer before shorter, block before allow.
    order = F.struct("site", F.when(F.col("site"), F.col("length")).otherwise(0).alias("length"), (F.col("says") == BLOCK).alias("block"), "name")
    best = (
        probes.join(hint(index), "token")
        .where(F.rlike(F.concat("host", "path"), F.col("regex")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("name", "says", "site"), order).alias("best"))
    )
    return rows.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.when(F.col("best.site"), F.col("best.name")).alias("rule"),
        F.when(~F.col("best.site"), F.col("best.name")).alias("pattern"), F.coalesce("best.says", F.lit(default)).alias("verdict"),
    )

"""Multi-term search: any, all or a number of terms, exclusions, whole words, highlighting."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import java_escape, prefix_sums

MAX_TERMS = 200
#: From so many terms on they are looked for in one scan.
SCAN_TERMS = 4


@dataclass(frozen=True)
class MultiSearch:
    """``terms`` count, ``excluded`` reject.  ``min_match`` None is ``mode``: "any" or "all"."""

    terms: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    mode: str = "any"
    min_match: int | None = None
    ignore_case: bool = True
    whole_word: bool = False
    regex: bool = False

    @classmethod
    def parse(cls, text: str, **options) -> MultiSearch:
        """Terms between commas or line breaks; one leading ``-`` or ``!`` excludes."""
        wanted, excluded = {}, {}
        for raw in re.split(r"[,\n]", text):
            term = raw.strip()
            into = excluded if term[:1] in ("-", "!") else wanted
            term = term[1:].strip() if into is excluded else term
            if term:
                into[term] = None
        return cls(tuple(wanted), tuple(excluded), **options)

    def problems(self, spark: SparkSession | None = None) -> list[tuple[int, str]]:
        """(number of the term, reason); empty if the search can run.  Expressions are compiled by Spark, which runs them, where there is a session."""
        spark = spark or SparkSession.getActiveSession()
        both = self.terms + self.excluded
        found = [(MAX_TERMS, f"more than {MAX_TERMS} terms")] if len(both) > MAX_TERMS else []
        for i, t in enumerate(both if self.regex else ()):
            try:
                spark.range(1).select(F.lit("").rlike(t)).collect() if spark else re.compile(t)
            except Exception as e:
                found.append((i, str(e).split("\n")[0]))
        return found

    def pattern(self, term: str) -> str:
        base = term if self.regex else java_escape(term)
        if self.whole_word:
            edge = lambda c: r"\b" if self.regex or c.isalnum() or c == "_" else r"\B"
            base = edge(term[0]) + base + edge(term[-1])
        return ("(?iu)" if self.ignore_case else "") + base

    def to_column(self, text: Column | None = None) -> Column:
        """The test on ``text``, by default message, thread and component joined by `` | ``."""
        if bad := self.problems():
            raise ValueError(f"term {bad[0][0]}: {bad[0][1]}")
        text = F.concat_ws(" | ", "message", "thread", "component") if text is None else text
        one_of = lambda ts: text.rlike("|".join(f"(?:{self.pattern(t)})" for t in ts))
        passed = F.lit(True)
        if self.excluded:
            passed &= ~F.coalesce(one_of(self.excluded), F.lit(False))
        if self.terms:
            need = min(max(self.min_match, 1), len(self.terms)) if self.min_match is not None else 1 if self.mode == "any" else len(self.terms)
            if need == 1:
                passed &= F.coalesce(one_of(self.terms), F.lit(False))
            elif self.one_scan():
                passed &= F.coalesce(F.size(self.terms_in(text)), F.lit(0)) >= need
            else:
                hits = [F.coalesce(text.rlike(self.pattern(t)), F.lit(False)).cast("int") for t in self.terms]
                passed &= sum(hits[1:], hits[0]) >= need
        return passed


    # ------------------------------------------------------------------ all terms in one scan
    def one_scan(self) -> bool:
        """Whether :meth:`terms_in` can tell the terms apart: literal ones, in ASCII if their case doesn't matter."""
        return len(self.terms) >= SCAN_TERMS and not self.regex and (not self.ignore_case or all(t.isascii() for t in self.terms))

    def _key(self, term: str) -> str:
        return term.lower() if self.ignore_case else term

    def _ends_at(self, term: str, size: int) -> bool:
        """Whether a term's first ``size`` characters are a match of their own where the term is."""
        if not self.whole_word or size == len(term):
            return True
        word = lambda c: c.isalnum() or c == "_"
        return (word(term[size - 1]) != word(term[size])) == word(term[size - 1])

    def scan_pattern(self) -> str:
        """An expression that captures, without taking anything, the longest term that begins at a place: common beginnings are shared, longer ones
        come first."""
        tree: dict = {}
        for term in self.terms:
            node = tree
            for c in self._key(term):
                node = node.setdefault(c, {})
            node[""] = term

        def edge(c: str) -> str:
            return (r"\b" if c.isalnum() or c == "_" else r"\B") if self.whole_word else ""

        def body(node: dict, last: str) -> str:
            ways = [java_escape(c) + body(n, c) for c, n in node.items() if c != ""]
            if "" in node:
                ways.append(edge(last))
            return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

        firsts = {c: edge(c) + java_escape(c) + body(n, c) for c, n in tree.items()}
        begin = "[" + "".join(java_escape(c) for c in firsts) + "]"
        return ("(?iu)" if self.ignore_case else "") + f"(?={begin})(?=({'|'.join(firsts.values())}))"

    def terms_in(self, text: Column) -> Column:
        """Numbers of the terms that are in ``text``, by one scan: what it captures at each place, and the terms that those begin with."""
        number = {self._key(t): i for i, t in enumerate(self.terms)}
        inside = {k: [i for u, i in number.items() if k.startswith(u) and self._ends_at(k, len(u))] for k in number}
        table = F.create_map(*[x for k, found in inside.items() for x in (F.lit(k), F.array(*map(F.lit, found)))])
        caught = F.regexp_extract_all(text, F.lit(self.scan_pattern()), F.lit(1))
        if self.ignore_case:
            # The characters outside ASCII that an expression takes for i, s and k.
            caught = F.transform(caught, lambda c: F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk")))
        return F.array_distinct(F.flatten(F.transform(F.array_distinct(caught), lambda c: F.element_at(table, c))))


def highlight(text: Column, search: MultiSearch) -> Column:
    """Byte ranges (start, end) of the terms' matches: sorted, with those that overlap or touch merged."""
    kind = "array<struct<start:int,end:int>>"

    def ranges(term: str) -> Column:
        p = search.pattern(term)
        hits, gaps = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)
        both = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.octet_length(g) + F.octet_length(h)).cast("long"))
        zipped = F.arrays_zip(hits.alias("h"), prefix_sums(both).alias("b"), F.slice(gaps, 1, F.size(hits)).alias("g"))
        start = lambda z: (z["b"] + F.octet_length(z["g"])).cast("int")
        each = F.transform(zipped, lambda z: F.struct(start(z).alias("start"), (start(z) + F.octet_length(z["h"])).alias("end")))
        return F.when(F.size(hits) > 0, each).otherwise(F.array().cast(kind))

    if not search.terms:
        return F.array().cast(kind)

    # A range opens where none before it reaches its start; it ends where the last before the next opening does.
    every = F.array_sort(F.concat(*[ranges(t) for t in search.terms]))

    def merge(acc: Column, r: Column) -> Column:
        apart = r["start"] > acc["end"]
        done = F.when(apart & (acc["end"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])
        return F.struct(F.when(apart, r["start"]).otherwise(acc["start"]).alias("start"), F.greatest(acc["end"], r["end"]).alias("end"), done.alias("out"))

    none = F.array().cast(kind)
    zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), none.alias("out"))
    last = lambda acc: F.when(acc["end"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])
    return F.aggregate(every, zero, merge, last)

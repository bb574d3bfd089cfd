"""The entry filter: one specification, one expression."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, contains_ci, fuzzy
from .search import MultiSearch

FIELDS = ("message", "thread", "component")


def parse_moment(text: str, tz: str, end: bool = False) -> datetime | None:
    """``YYYY-MM-DD[ HH:MM[:SS]]`` of time zone ``tz`` as UTC; a date alone is its first second, or its last with ``end``."""
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?)?", text.strip())
    if not m:
        return None
    clock = (m[4], m[5], m[6] or "0") if m[4] else ("23", "59", "59") if end else ("0", "0", "0")
    try:
        local = datetime(*map(int, (*m.groups()[:3], *clock)), tzinfo=ZoneInfo(tz))
    except ValueError:
        return None
    return local.astimezone(ZoneInfo("UTC"))


@dataclass(frozen=True)
class FilterSpec:
    """Conditions that all hold; one that isn't set adds nothing."""

    severities: frozenset[str] = frozenset()
    sources: frozenset[str] = frozenset()
    hide_all_sources: bool = False
    hide_untimed: bool = False
    start: datetime | None = None
    end: datetime | None = None
    last_seconds: int | None = None
    text: str = ""
    fuzzy: bool = False
    regex: str = ""
    exclude: str = ""
    components: frozenset[str] = frozenset()
    bookmarked: bool = False
    active_seconds: int | None = None
    at_least: str | None = None
    search: MultiSearch = field(default_factory=MultiSearch)

    @classmethod
    def errors_only(cls, base: FilterSpec | None = None) -> FilterSpec:
        return replace(base or cls(), severities=frozenset(SEVERITIES[:2]))

    @classmethod
    def errors_and_warnings(cls, base: FilterSpec | None = None) -> FilterSpec:
        return replace(base or cls(), severities=frozenset(SEVERITIES[:3]))

    @classmethod
    def recent_problems(cls, base: FilterSpec | None = None) -> FilterSpec:
        """Errors and warnings of the last 15 minutes."""
        return replace(cls.errors_and_warnings(base), last_seconds=900)

    def to_column(self, as_of: datetime | None = None) -> Column:
        """The row conditions, cheap ones first; severity, time and source reach the Parquet scan."""
        tests: list[Column] = []
        if self.severities and len(self.severities) < len(SEVERITIES):
            tests.append(F.col("severity").isin(*sorted(self.severities)))
        if self.at_least:
            tests.append(F.col("severity_rank") <= SEVERITIES.index(self.at_least))
        if self.hide_all_sources:
            tests.append(F.lit(False))
        elif self.sources:
            tests.append(F.col("source_file").isin(*sorted(self.sources)))
        if self.hide_untimed:
            tests.append(F.col("timestamp").isNotNull())
        start, end = self.start, self.end
        if self.last_seconds is not None:
            if as_of is None:
                raise ValueError("a relative window needs as_of")
            start, end = as_of - timedelta(seconds=self.last_seconds), None
        when = F.coalesce("timestamp", "file_modified")
        if start is not None:
            tests.append(when >= F.lit(start))
        if end is not None:
            tests.append(when <= F.lit(end))
        if self.text:
            tests.append(self._any(lambda c: fuzzy(c, self.text) if self.fuzzy else contains_ci(c, self.text)))
        if self.regex:
            re.compile(self.regex)
            tests.append(self._any(lambda c: F.coalesce(c.rlike("(?iu)" + self.regex), F.lit(False))))
        if self.exclude:
            tests.append(~self._any(lambda c: contains_ci(c, self.exclude)))
        if self.components:
            tests.append(F.col("component").isin(*sorted(self.components)))
        if self.search.terms or self.search.excluded:
            tests.append(self.search.to_column())
        out = F.lit(True)
        for t in tests:
            out = out & F.coalesce(t, F.lit(False)) if t is not tests[0] else t
        return out

    @staticmethod
    def _any(test) -> Column:
        a, b, c = (test(F.col(name)) for name in FIELDS)
        return a | b | c

    def describe(self) -> str:
        """The conditions in words, for exports."""
        parts = []
        if self.severities and len(self.severities) < len(SEVERITIES):
            parts.append("severity: " + ", ".join(s for s in SEVERITIES if s in self.severities))
        if self.at_least:
            parts.append(f"severity at least {self.at_least}")
        if self.hide_all_sources or self.sources:
            parts.append("no files" if self.hide_all_sources else f"{len(self.sources)} files")
        if self.last_seconds is not None:
            parts.append(f"last {self.last_seconds} s")
        elif self.start or self.end:
            parts.append(f"time: {self.start or '...'} to {self.end or '...'}")
        for label, value in (("text", self.text), ("regex", self.regex), ("without", self.exclude), ("components", ", ".join(sorted(self.components))), ("terms", ", ".join(self.search.terms)), ("no terms", ", ".join(self.search.excluded))):
            if value:
                parts.append(f"{label}: {value}")
        parts += [label for label, on in (("fuzzy", self.fuzzy), ("timed only", self.hide_untimed), ("bookmarked", self.bookmarked), ("active files", self.active_seconds is not None)) if on]
        return "; ".join(parts) or "none"


def apply_filters(entries: DataFrame, spec: FilterSpec, as_of: datetime | None = None, annotations: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Entries that pass; bookmarks (``annotations(id, label)``) and active files (``files(path, modified)``) are semi joins."""
    out = entries.where(spec.to_column(as_of))
    if spec.bookmarked:
        if annotations is None:
            raise ValueError("a bookmark filter needs annotations")
        out = out.join(annotations.select("id").distinct(), "id", "left_semi")
    if spec.active_seconds is not None:
        if files is None or as_of is None:
            raise ValueError("an activity window needs files and as_of")
        fresh = F.col("modified").isNull() | (F.col("modified") >= F.lit(as_of - timedelta(seconds=spec.active_seconds)))
        out = out.join(files.where(fresh).select(F.col("path").alias("source_file")).distinct(), "source_file", "left_semi")
    return out

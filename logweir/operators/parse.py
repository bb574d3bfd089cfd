"""Lines -> entries: extraction, folding of multi-line entries, severity, timestamps, errors, ids.

``parse_lines`` takes any DataFrame with ``source_file, line_number, line`` and optionally ``file_modified``.  Nothing needs a
file's lines in one task: running values within a file are computed per block of lines, with one row per block carrying what came before.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import materialize
from ..functions.text import severity_rank, truncate_bytes
from ..functions.timestamps import parse_timestamp, sniff_timestamp, sniffed_tier
from ..sources.profiles import LEVELS, PLAIN_TEXT, Profile, java_regex

MAX_ENTRY_BYTES, MAX_ERRORS, SNIFF_LINES = 65_536, 1000, 200
#: Lines of a file that are numbered in one task.
BLOCK_LINES = 200_000
COLUMNS = ("timestamp", "severity", "severity_rank", "source_file", "line_number", "thread", "component", "message", "raw_text", "profile_id", "file_modified")


def _lines(lines: DataFrame) -> DataFrame:
    modified = F.col("file_modified") if "file_modified" in lines.columns else F.lit(None).cast("timestamp")
    return lines.select("source_file", F.col("line_number").cast("long").alias("line_number"), "line", modified.alias("file_modified"))


def severity_of(level: Column | None, message: Column, profile: Profile) -> Column:
    """A level that matched is mapped; without a mapping the message's overrides decide, and without a level
    also its keywords.  More severe rules come first."""
    words = [(k, profile.levels.get(k, [])) for k in LEVELS]
    mapped = F.coalesce(*[F.when(F.lower(level).isin([w.lower() for w in ws]), k) for k, ws in words if ws], F.lit(None)) if level is not None else F.lit(None)
    rules = [(k, profile.overrides.get(k, [])) for k in LEVELS]
    overridden = F.coalesce(*[F.when(message.rlike("|".join(f"(?:{java_regex(p)})" for p in ps)), k) for k, ps in rules if ps], F.lit(None))
    lowered = F.lower(message)

    def any_word(ws: list[str]) -> Column:
        found = F.lit(False)
        for w in ws:
            found |= F.contains(lowered, F.lit(w.lower()))
        return found

    keyword = F.coalesce(*[F.when(any_word(ws), k) for k, ws in words if ws], F.lit(None))
    no_level = level.isNull() if level is not None else F.lit(True)
    return F.coalesce(mapped, overridden, F.when(no_level, keyword), F.lit("Unknown"))


#: Separates the groups of a match; a line that has it is matched group by group.
_MARK = "\ufdd1"


def extract(lines: DataFrame, profile: Profile) -> DataFrame:
    """Lines that aren't blank, with ``hit`` and the groups of the profile's expression, which runs once a line."""
    pattern, body = java_regex(profile.line), profile.line
    names = [k for k in ("timestamp", "level", "thread", "component", "message") if profile.group(k)]
    # The whole line becomes its groups; a line without a match stays as it is, without marks.
    skipped = "" if body.startswith("^") else r"\A[\s\S]*?"
    whole = java_regex(f"{skipped}(?:{body})[\\s\\S]*\\z")
    groups = "".join(f"{_MARK}${profile.group(k)}" for k in names)
    rows = _lines(lines).where(~F.col("line").rlike(r"^\s*$"))
    rows = rows.withColumn("odd", F.contains("line", F.lit(_MARK))).withColumn("parts", F.split(F.regexp_replace("line", whole, groups + _MARK), _MARK))
    hit = F.when(F.col("odd"), F.col("line").rlike(pattern)).otherwise(F.size("parts") > 1)
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))

    def group(name: str) -> Column:
        if name not in names:
            return F.lit(None).cast("string")
        value = F.when(F.col("odd"), F.regexp_extract("line", pattern, profile.group(name))).otherwise(F.get("parts", F.lit(names.index(name) + 1)))
        return F.when(F.col("hit"), F.nullif(value, F.lit("")))

    message = group("message") if "message" in names else F.col("line")
    return rows.select(
        "source_file", "line_number", "line", "file_modified", "hit",
        group("timestamp").alias("stamp"), group("level").alias("level"), group("thread").alias("thread"), group("component").alias("component"),
        F.when(F.col("hit"), F.coalesce(message, F.lit(""))).otherwise(F.col("line")).alias("part"),
    )


def with_heads(rows: DataFrame) -> DataFrame:
    """Add ``head``, the line of the last hit at or before a line (null before a file's first hit), and ``ahead``, the bytes of
    the entry before the line."""
    rows = rows.withColumn("block", F.floor(F.col("line_number") / BLOCK_LINES))
    mark, size = F.when(F.col("hit"), F.col("line_number")), F.octet_length("part") + 1
    own = Window.partitionBy("source_file", "block").orderBy("line_number")
    # Of each block: all bytes, the last hit, and the bytes behind its start.
    last = F.max(F.when(F.col("hit"), F.struct("line_number", (F.col("upto") - size).alias("at"))))
    numbered = rows.withColumn("upto", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = numbered.groupBy("source_file", "block").agg(F.max("upto").alias("bytes"), last.alias("last"))
    upto = Window.partitionBy("source_file").orderBy("block")
    placed = sums.withColumn("start", F.sum("bytes").over(upto) - F.col("bytes"))
    carried = F.max(F.struct(F.col("last.line_number").alias("head"), (F.col("start") + F.col("last.at")).alias("at"))).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.select("source_file", "block", "start", carried.alias("carried"))
    at = F.max(F.when(F.col("hit"), F.struct(F.col("line_number").alias("head"), (F.col("upto") - size).alias("at")))).over(own)
    marked = numbered.withColumn("own", at).join(placed, ["source_file", "block"])
    head, begin = F.coalesce("own.head", "carried.head"), F.coalesce(F.col("start") + F.col("own.at"), "carried.at")
    return marked.withColumn("ahead", F.col("start") + F.col("upto") - size - begin).withColumn("head", head).drop("block", "carried", "own", "upto", "start")


def tier_hints(lines: DataFrame, as_of: datetime, most: int = SNIFF_LINES) -> DataFrame:
    """``source_file, tier``: how most times are written in the first ``most`` lines of each file that has any, to be given to :func:`parse_lines`.

    A row a file, written once, so that Spark knows its size and broadcasts it where it is small.
    """
    first = _lines(lines).where(F.col("line_number") <= most).select("source_file", sniffed_tier(F.col("line"), as_of).alias("tier"))
    counts = first.where(F.col("tier").isNotNull()).groupBy("source_file", "tier").agg(F.count("*").alias("n"))
    return materialize(counts.groupBy("source_file").agg(F.max_by("tier", F.struct("n", -F.col("tier"))).alias("tier")), "tiers")


def parse_lines(lines: DataFrame, profile: Profile, as_of: datetime, hints: DataFrame | None = None) -> DataFrame:
    """Entries of ``lines`` by one profile (:data:`COLUMNS`; ids come from :func:`assign_ids`).

    ``as_of`` stands for the clock: the year of formats without one, the day of times without one.  Where times are looked for in the text,
    a file's tier in ``hints`` is tried first and the others only where it finds nothing.
    """
    rows = extract(lines, profile)
    level = F.col("level") if profile.group("level") else None
    severity = severity_of(level, F.col("part"), profile)
    if profile.mode == "raw":
        # A line that doesn't fit is an entry of its own.
        rows = rows.withColumns({"severity": F.when(F.col("hit"), severity).otherwise(F.lit("Unknown")), "message": F.col("part"), "raw_text": F.col("line")})
    elif profile.mode == "skip":
        rows = rows.where("hit").withColumns({"severity": severity, "message": F.col("part"), "raw_text": F.col("line")})
    else:
        headed = with_heads(rows).where("head is not null")
        # Lines behind an entry's largest size are cut off anyway; one byte more shows that there was more.
        headed = headed.where(F.col("ahead") <= MAX_ENTRY_BYTES + 1)
        first = lambda c: F.max(F.when(F.col("hit"), F.col(c))).alias(c)
        joined = F.array_sort(F.collect_list(F.struct("line_number", "part", "line")))
        text = lambda f: F.array_join(F.transform("all", lambda x: x[f]), "\n")
        grouped = headed.withColumn("sev", severity).groupBy("source_file", "head").agg(
            first("stamp"), first("thread"), first("component"), F.max(F.when(F.col("hit"), F.col("sev"))).alias("severity"), F.max("file_modified").alias("file_modified"), joined.alias("all")
        )
        rows = grouped.withColumns({"message": text("part"), "raw_text": text("line")}).withColumnRenamed("head", "line_number")
    stamped = parse_timestamp(F.col("stamp"), profile.format, as_of) if profile.group("timestamp") else F.lit(None).cast("timestamp")
    if hints is not None:
        rows = rows.join(hints.select("source_file", "tier"), "source_file", "left")
    sniffed = sniff_timestamp(F.col("raw_text"), as_of, F.col("tier") if hints is not None else None)
    return rows.select(
        F.coalesce(stamped, sniffed).alias("timestamp"), "severity", severity_rank(F.col("severity")).alias("severity_rank"), "source_file", "line_number",
        "thread", "component", truncate_bytes(F.col("message"), MAX_ENTRY_BYTES).alias("message"), truncate_bytes(F.col("raw_text"), MAX_ENTRY_BYTES).alias("raw_text"),
        F.lit(profile.id).alias("profile_id"), "file_modified",
    )


def parse_errors(lines: DataFrame, profile: Profile, as_of: datetime, most: int = MAX_ERRORS) -> DataFrame:
    """``source_file, line_number, reason``: timestamps that don't parse, and lines that fit nothing (in continuation mode only
    those before a file's first entry, in raw mode none); at most ``most`` a file, the first ones."""
    rows = extract(lines, profile)
    failed = F.lit(False)
    if profile.group("timestamp"):
        failed = F.col("hit") & F.col("stamp").isNotNull() & parse_timestamp(F.col("stamp"), profile.format, as_of).isNull()
    if profile.mode == "continuation":
        rows = with_heads(rows)
        unmatched = ~F.col("hit") & F.col("head").isNull()
    else:
        unmatched = F.lit(False) if profile.mode == "raw" else ~F.col("hit")
    reason = F.when(failed, "timestamp").when(unmatched, "line")
    found = rows.select("source_file", "line_number", reason.alias("reason")).where("reason is not null")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("source_file").orderBy("line_number"))).where(F.col("r") <= most).drop("r")


def parse_all(lines: DataFrame, detected: DataFrame, profiles: list[Profile], as_of: datetime, hints: DataFrame | None = None) -> DataFrame:
    """Entries of all files, each by its detected profile (``path, profile_id``); files whose profile finds
    nothing in them, and files that ``detected`` doesn't have, are plain text.  Profiles that no file has cost nothing."""
    by_id = {p.id: p for p in profiles}
    wanted = detected.groupBy(F.col("path").alias("source_file")).agg(F.max("profile_id").alias("wanted"))
    present = sorted(r.wanted for r in wanted.select("wanted").distinct().collect() if r.wanted in by_id and r.wanted != PLAIN_TEXT)
    named = lines.join(wanted, "source_file", "left")
    if present:
        # One pass tells which files have a line of their profile; raw profiles take any.
        fits = F.coalesce(*[F.when(F.col("wanted") == i, F.col("line").rlike(java_regex(by_id[i].line)) if by_id[i].mode != "raw" else F.lit(True)) for i in present], F.lit(False))
        found = named.where(F.col("wanted").isin(*present)).groupBy("source_file").agg(F.max(F.coalesce(fits, F.lit(False))).alias("found"))
        final = wanted.join(found.where("found"), "source_file").select("source_file", F.col("wanted").alias("profile_id"))
        named = lines.join(materialize(final, "profiles"), "source_file", "left")
    else:
        named = lines.withColumn("profile_id", F.lit(None).cast("string"))
    out = parse_lines(named.where(F.col("profile_id").isNull()).drop("profile_id"), by_id[PLAIN_TEXT], as_of, hints)
    for i in present:
        out = out.unionByName(parse_lines(named.where(F.col("profile_id") == i).drop("profile_id"), by_id[i], as_of, hints))
    return out


def assign_ids(entries: DataFrame, start: int = 0) -> DataFrame:
    """Add ``id``: consecutive from ``start`` in the order of (directory, path, line), without a global sort; entries without a
    file or a line number come last, those of a file in the order of time and text.

    Counts per file and block of lines give every block its first id; only those counts (a row a block) are ordered globally.
    """
    folder = F.regexp_replace("source_file", r"[^/\\]*$", "")
    e = entries.withColumns({"folder": folder, "block": F.floor(F.col("line_number") / BLOCK_LINES)})
    counts = e.groupBy("folder", "source_file", "block").count()
    order = [F.asc_nulls_last(c) for c in ("folder", "source_file", "block")]
    first = counts.select(F.col("source_file").alias("f"), F.col("block").alias("b"), (F.sum("count").over(Window.orderBy(*order)) - F.col("count")).alias("before"))
    ties = [F.asc_nulls_last(c) for c in ("line_number", "timestamp", "raw_text", "message") if c in entries.columns]
    own = F.row_number().over(Window.partitionBy("source_file", "block").orderBy(*ties))
    numbered = e.withColumn("own", own).join(first, F.col("source_file").eqNullSafe(F.col("f")) & F.col("block").eqNullSafe(F.col("b")))
    return numbered.withColumn("id", F.col("own") - 1 + F.col("before") + start).drop("own", "before", "block", "folder", "f", "b")


def next_id(entries: DataFrame, high_water: int = -1) -> int:
    """An id above all present ones and above ``high_water``, so ids of removed entries aren't given again."""
    return max(high_water, *(x for x in [entries.agg(F.max("id")).first()[0]] if x is not None), -1) + 1


def cap_entries(entries: DataFrame, most: int, start: int = 0) -> DataFrame:
    """The first ``most`` entries in id order (an option of a scan, off unless asked for)."""
    return entries.where(F.col("id") < start + most)


def only_errors(entries: DataFrame) -> DataFrame:
    """The ingest gate: Critical and Error."""
    return entries.where(F.col("severity").isin("Critical", "Error"))


def remove_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries without those of ``files(path)``."""
    return entries.join(files.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_anti")

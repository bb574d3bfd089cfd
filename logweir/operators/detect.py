"""Which format a file has, and proposing a profile for files of no known format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_name, matches_glob
from ..sources.profiles import PLAIN_TEXT, Profile, java_regex

SAMPLE_LINES, NAME_BONUS, LEAST = 20, 0.3, 0.3


def detect_formats(lines: DataFrame, files: DataFrame, profiles: list[Profile], prefer_name_match: bool = False) -> DataFrame:
    """``path, profile_id, detection_confidence`` for every row of ``files(path)``.

    The score is the share of the first lines that fit, plus a bonus for the name, 1 at most; the best of those from 0.3, the earlier
    profile on ties.  Files without lines are judged by name, files that nothing fits are plain text.
    """
    scored = [(i, p) for i, p in enumerate(profiles) if p.id != PLAIN_TEXT]
    # One aggregate with a column per profile reads the sample once.
    share = [F.avg(F.col("line").rlike(java_regex(p.content)).cast("double")).alias(f"s{i}") for i, p in scored]
    sample = lines.where(F.col("line_number") <= SAMPLE_LINES).groupBy(F.col("source_file").alias("path")).agg(*share)
    name = base_name(F.col("path"))

    def candidate(i: int, p: Profile) -> Column:
        named = matches_glob(name, list(p.files), ignore_case=True)
        total = F.coalesce(F.col(f"s{i}"), F.lit(0.0))
        total = F.when(named, F.least(F.lit(1.0), total + NAME_BONUS)).otherwise(total)
        first = named.cast("int") if prefer_name_match else F.lit(0)
        return F.struct(total.alias("confidence"), first.alias("named"), F.lit(-i).alias("order"), F.lit(p.id).alias("id"))

    best = F.array_max(F.filter(F.array(*[candidate(i, p) for i, p in scored]), lambda c: c["confidence"] >= LEAST))
    judged = files.select("path").distinct().join(sample, "path", "left").select("path", best.alias("best"))
    return judged.select("path", F.coalesce("best.id", F.lit(PLAIN_TEXT)).alias("profile_id"), F.coalesce("best.confidence", F.lit(0.0)).alias("detection_confidence"))


# Shapes of timestamps that a proposed profile may have, the first of the best share wins.
SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})", "%Y-%m-%dT%H:%M:%S%.f%z"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?", "%Y-%m-%d %H:%M:%S"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+", "%Y-%m-%d %H:%M:%S,%3f"),
    (r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}", "%d.%m.%Y %H:%M:%S"),
    (r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}", "%d/%b/%Y:%H:%M:%S %z"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}", "%m/%d/%Y %H:%M"),
    (r"^\d{1,2}/\d{1,2}/\d{2} \d{2}:\d{2}:\d{2}", "%m/%d/%y %H:%M:%S"),
    (r"^[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}", "%b %e %H:%M:%S"),
    (r"^\d{1,2} [A-Z][a-z]+ \d{4} \d{2}:\d{2}:\d{2}", "%d %B %Y %H:%M:%S"),
)
LEVEL_WORDS = {"Critical": ["FATAL", "CRITICAL"], "Error": ["ERROR"], "Warning": ["WARNING", "WARN"], "Info": ["INFO"], "Debug": ["DEBUG", "TRACE"]}


def infer_profile(lines: DataFrame, files_per_group: int = 5, lines_per_group: int = 50, confident: float = 0.6, anchored: float = 0.5) -> DataFrame:
    """A proposal per group of files: ``stem, glob, timestamp_format, timestamp_share, anchor, anchor_share, levels``.

    Files whose names differ in digits only are a group; its newest files give the sample.
    """
    name = base_name(F.col("source_file"))
    stem = F.regexp_replace(F.lower(name), r"[0-9]+", "")
    named = lines.where(F.col("line_number") <= lines_per_group).withColumn("stem", stem)
    newest = Window.partitionBy("stem").orderBy(F.desc_nulls_last("file_modified"), "source_file")
    chosen = named.select("stem", "source_file", "file_modified").distinct().withColumn("r", F.row_number().over(newest)).where(F.col("r") <= files_per_group)
    within = Window.partitionBy("stem").orderBy("r", "line_number")
    sample = named.join(chosen.select("source_file", "r"), "source_file").where(F.trim("line") != "").withColumn("k", F.row_number().over(within)).where(F.col("k") <= lines_per_group)
    shares = F.array(*[F.struct(F.avg(F.col("line").rlike(p).cast("double")).alias("share"), F.lit(-i).alias("order"), F.lit(f).alias("format")) for i, (p, f) in enumerate(SHAPES)])
    words = F.array_compact(F.array(*[F.when(F.max(F.col("line").rlike(rf"(?i)\b(?:{'|'.join(w)})\b")), k) for k, w in LEVEL_WORDS.items()]))
    glob = F.concat(F.regexp_replace(F.min(name), r"[0-9]+", "*"))
    facts = sample.groupBy("stem").agg(F.array_max(shares).alias("best"), words.alias("levels"), glob.alias("glob"), F.count("*").alias("n"))
    prefix = F.regexp_replace(F.regexp_extract("line", r"^\s*(\S+(?:\s+\S+){0,2})", 1), r"\d+", "N")
    common = sample.where(F.char_length(prefix) <= 40).groupBy("stem", prefix.alias("anchor")).count()
    top = common.groupBy("stem").agg(F.max(F.struct(F.col("count"), F.col("anchor"))).alias("top"))
    good = F.col("best.share") >= confident
    share = F.col("top.count") / F.col("n")
    return facts.join(top, "stem", "left").select(
        "stem", "glob", F.when(good, F.col("best.format")).alias("timestamp_format"), F.col("best.share").alias("timestamp_share"),
        F.when(share >= anchored, F.col("top.anchor")).alias("anchor"), share.alias("anchor_share"), "levels",
    )


def proposed(row, profile_id: str) -> Profile:
    """A profile from a row of :func:`infer_profile`; it has to be checked by its reader."""
    shape = next((p for p, f in SHAPES if f == row.timestamp_format), r"^\S")
    begin, body = ("^", shape[1:]) if shape.startswith("^") else ("", shape)
    line = rf"{begin}(?P<timestamp>{body})\]?\s*(?P<message>.+)$"
    return Profile(profile_id, profile_id, shape, line, row.timestamp_format or "", files=(row.glob,), levels={k: LEVEL_WORDS[k] for k in row.levels})

"""Dedup, summaries, previews, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import materialize
from ..functions.text import base_name, normalize_message, preview

PREVIEW_ROWS = 50
#: A key with more entries is joined without a shuffle; in a larger table one with more than a ``MOST_HOT``-th of it, so that these are fewer than ``MOST_HOT``.
HOT_ROWS, MOST_HOT = 10_000, 10_000


def _keyed(entries: DataFrame, normalized: bool) -> DataFrame:
    key = normalize_message(F.col("message")) if normalized else F.col("message")
    return entries.select(F.struct(*entries.columns).alias("row"), F.col("source_file").alias("file"), F.sha2(key.cast("binary"), 256).alias("mark"))


def survivors(entries: DataFrame, normalized: bool = False, sums: dict[str, str] | None = None) -> DataFrame:
    """One entry per (file, message): the latest, then that with the highest id; with ``count`` and ``first_timestamp``, and for
    each name in ``sums`` the sum of that column over the group.  All aggregates combine map-side."""
    kept = _survivors(_keyed(entries, normalized), sums or {})
    return kept.select("row.*", "count", "first_timestamp", *(sums or {}))


def _survivors(keyed: DataFrame, sums: dict[str, str]) -> DataFrame:
    at = F.struct("row.timestamp", "row.id")
    more = [F.sum(f"row.{column}").alias(name) for name, column in sums.items()]
    return keyed.groupBy("file", "mark").agg(F.max_by("row", at).alias("row"), F.count("*").alias("count"), F.min("row.timestamp").alias("first_timestamp"), *more)


def occurrences(entries: DataFrame, normalized: bool = False) -> DataFrame:
    """A row for each entry: ``survivor_id`` (of :func:`survivors`), ``timestamp``, ``id``, ``line_number``.  Entries of hot keys find their
    survivor in a broadcast table of fewer than ``MOST_HOT`` rows, so no task gets a group's rows because it is one group."""
    keyed = _keyed(entries, normalized)
    kept = _survivors(keyed, {}).select(F.col("file").alias("f"), F.col("mark").alias("m"), F.col("row.id").alias("survivor_id"), "count")
    kept = materialize(kept, "survivors")
    least = max(HOT_ROWS, (kept.agg(F.sum("count")).first()[0] or 0) // MOST_HOT)
    hot, rest = F.broadcast(kept.where(F.col("count") > least)), kept.where(F.col("count") <= least)
    same = F.col("file").eqNullSafe(F.col("f")) & F.col("mark").eqNullSafe(F.col("m"))
    slim = keyed.select("file", "mark", "row.timestamp", "row.id", "row.line_number")
    out = ("survivor_id", "timestamp", "id", "line_number")
    return slim.join(hot, same).select(*out).unionByName(slim.join(hot, same, "left_anti").join(rest, same).select(*out))


def dedup(entries: DataFrame, normalized: bool = False) -> DataFrame:
    """One entry per (file, message): the latest, then that with the highest id; with ``count``, ``first_timestamp`` and
    ``occurrences`` (timestamp, id, line_number) in order.  ``normalized`` groups by the message without its variable parts.
    A group's occurrences must fit into one row: for groups of any size there are :func:`survivors` and :func:`occurrences`."""
    key = normalize_message(F.col("message")) if normalized else F.col("message")
    at = F.struct("timestamp", "id")
    grouped = entries.withColumn("key", key).groupBy("source_file", "key").agg(
        F.max_by(F.struct(*entries.columns), at).alias("row"), F.count("*").alias("count"), F.min("timestamp").alias("first_timestamp"),
        F.sort_array(F.collect_list(F.struct("timestamp", "id", "line_number"))).alias("occurrences"),
    )
    return grouped.select("row.*", "count", "first_timestamp", "occurrences")


def expand_occurrences(deduped: DataFrame) -> DataFrame:
    """A row for each occurrence: ``id`` of the survivor, ``position``, and the occurrence."""
    return deduped.select("id", F.posexplode("occurrences").alias("position", "o")).select("id", "position", F.col("o.timestamp").alias("timestamp"), F.col("o.id").alias("occurrence_id"), F.col("o.line_number").alias("line_number"))


def severity_breakdown(entries: DataFrame) -> DataFrame:
    """``severity, n, share`` (percent) of the severities that occur."""
    counts = entries.groupBy("severity").agg(F.count("*").alias("n"))
    return counts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def severity_preview(entries: DataFrame, most: int = PREVIEW_ROWS) -> DataFrame:
    """The first entries of each severity in timeline order: ``severity, position, clock, file, preview``."""
    order = Window.partitionBy("severity").orderBy(F.asc_nulls_last("timestamp"), "id")
    rows = entries.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return rows.select("severity", "position", F.date_format("timestamp", "HH:mm:ss").alias("clock"), base_name(F.col("source_file")).alias("file"), preview(F.col("message")).alias("preview"))


def file_summary(entries: DataFrame, files: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """``path, profile_id, entry_count, error_count, earliest, latest``; ``files(path, profile_id)`` adds files
    without entries, ``errors(source_file)`` the parse errors."""
    own = entries.groupBy(F.col("source_file").alias("path"), "profile_id").agg(F.count("*").alias("entry_count"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))
    if files is not None:
        own = files.select("path", F.col("profile_id").alias("known")).join(own, "path", "left").select(
            "path", F.coalesce("profile_id", "known").alias("profile_id"), F.coalesce("entry_count", F.lit(0)).alias("entry_count"), "earliest", "latest"
        )
    if errors is None:
        return own.withColumn("error_count", F.lit(0).cast("long"))
    bad = errors.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("bad"))
    return own.join(bad, "path", "left").withColumn("error_count", F.coalesce("bad", F.lit(0))).drop("bad")


def scan_summary(summary: DataFrame) -> DataFrame:
    """One row over :func:`file_summary`."""
    return summary.agg(
        F.count("*").alias("files"), F.count_if(F.col("entry_count") > 0).alias("files_with_entries"), F.count_if(F.col("error_count") > 0).alias("files_with_errors"),
        F.sum("entry_count").alias("entries"), F.sum("error_count").alias("errors"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"),
    )


def distinct_components(entries: DataFrame) -> DataFrame:
    return entries.select("component").where("component is not null").distinct().orderBy("component")


def counts(entries: DataFrame, passed: Column) -> DataFrame:
    """``total, matched, hidden, untimed`` in one pass."""
    hit = F.coalesce(passed, F.lit(False))
    return entries.agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("hidden"), F.count_if(F.col("timestamp").isNull()).alias("untimed"))


def timeline(entries: DataFrame, newest_first: bool = False, limit: int | None = None, after: tuple | None = None) -> DataFrame:
    """By time, entries without one last, ties by id; newest first is the exact reverse.  ``limit`` makes it a top-k;
    ``after`` = (timestamp, id) of a page's last row gives the next page (of timed entries, then the untimed)."""
    if after is not None:
        ts, row = after
        t = F.col("timestamp")
        if ts is None:
            rest = t.isNull() & ((F.col("id") < row) if newest_first else (F.col("id") > row))
            rest = rest | t.isNotNull() if newest_first else rest
        elif newest_first:
            rest = (t < F.lit(ts)) | ((t == F.lit(ts)) & (F.col("id") < row))
        else:
            rest = (t > F.lit(ts)) | ((t == F.lit(ts)) & (F.col("id") > row)) | t.isNull()
        entries = entries.where(rest)
    order = [F.desc_nulls_first("timestamp"), F.desc("id")] if newest_first else [F.asc_nulls_last("timestamp"), F.asc("id")]
    out = entries.orderBy(*order)
    return out.limit(limit) if limit is not None else out


def refresh_modified(rows: DataFrame, files: DataFrame, path: str = "source_file", column: str = "file_modified") -> DataFrame:
    """``rows`` with newer modification times of ``files(path, modified)`` where there are any."""
    new = files.select(F.col("path").alias(path), F.col("modified").alias("newer"))
    return rows.join(new, path, "left").withColumn(column, F.coalesce("newer", column)).drop("newer")


def bookmarks(entries: DataFrame, annotations: DataFrame) -> DataFrame:
    """Bookmarked entries with their ``label``, by id."""
    return entries.join(annotations.select("id", "label"), "id").orderBy("id")

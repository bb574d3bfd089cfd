"""Exports and reports."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, format_utc, rfc3339
from .analyse import timeline

CSV_COLUMNS = ("timestamp", "severity", "source_file", "line", "thread", "component", "message")
REPORT_ROWS, RAW_CHARS = 10_000, 500


def _metadata(df: DataFrame, path: str, exported: datetime, filters: str) -> None:
    """A side file, as comments would break part files."""
    spark = df.sparkSession
    text = json.dumps({"exported_at": exported.isoformat(), "entries": df.count(), "filters": filters})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_export_metadata.json")


def export_csv(entries: DataFrame, path: str, exported: datetime, filters: str = "none") -> None:
    """CSV with header and RFC 3339 times; nulls are empty, quotes doubled."""
    rows = entries.select(
        rfc3339(F.col("timestamp")).alias("timestamp"), "severity", "source_file", F.col("line_number").alias("line"), "thread", "component", "message"
    )
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    _metadata(entries, path, exported, filters)


def export_json(entries: DataFrame, path: str, exported: datetime, filters: str = "none") -> None:
    """JSON lines with all fields but the file's modification time."""
    entries.drop("file_modified").withColumn("timestamp", rfc3339(F.col("timestamp"))).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    _metadata(entries, path, exported, filters)


def write_tables(entries: DataFrame, path: str) -> None:
    """Parquet by profile: readers of one format read no other's files."""
    entries.write.mode("overwrite").partitionBy("profile_id").parquet(path)


def _head() -> Column:
    stamp = F.coalesce(format_utc(F.col("timestamp")), F.lit("no timestamp"))
    return F.format_string("[%s] %s  %s", stamp, F.rpad(F.upper("severity"), 8, " "), base_name(F.col("source_file")))


def report(entries: DataFrame, title: str = "Log report", most: int = REPORT_ROWS) -> DataFrame:
    """``value`` lines of the filtered timeline: a header, an entry in two lines, and a note if rows were left out.

    Order is by ``part`` and the timeline; write it with ``coalesce(1)`` for a single file.
    """
    total = entries.count()
    rows = timeline(entries, limit=most)
    body = F.concat(_head(), F.lit("\n  "), F.substring("raw_text", 1, RAW_CHARS))
    spark = entries.sparkSession
    head = spark.createDataFrame([(f"{title}\n{total} entries\n",)], "value string")
    note = spark.createDataFrame([(f"... {total - most} more entries aren't shown",)] if total > most else [], "value string")
    key = lambda part: [F.lit(part).alias("part"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(0).cast("long").alias("id")]
    every = head.select("value", *key(0)).unionByName(rows.select(body.alias("value"), F.lit(1).alias("part"), "timestamp", F.col("id").cast("long").alias("id"))).unionByName(note.select("value", *key(2)))
    return every.orderBy("part", F.asc_nulls_last("timestamp"), "id").select("value")


def bookmark_report(entries: DataFrame, annotations: DataFrame) -> DataFrame:
    """``value`` lines of the bookmarked entries by id, with their label."""
    label = F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.concat(F.lit(" ["), F.col("label"), F.lit("]"))).otherwise(F.lit(""))
    value = F.concat(_head(), label, F.lit("\n  "), F.substring("raw_text", 1, RAW_CHARS))
    return entries.join(annotations.select("id", "label"), "id").orderBy("id").select(value.alias("value"))


def selected_text(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The raw text of chosen entries, by id."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi").orderBy("id").select(F.col("raw_text").alias("value"))

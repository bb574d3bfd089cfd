"""The driver's tables as log entries and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import severity_rank

SEVERITY_OF = {"error": "Error", "signup": "Warning", "purchase": "Info", "click": "Debug"}


def events_lens(spark: SparkSession, sf_dir: str, untimed: bool = False) -> DataFrame:
    """``events`` as entries; ``untimed`` takes the time of every seventh row away and gives all files a modification time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    severity = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in SEVERITY_OF.items()], F.lit("Unknown"))
    message = F.concat("event_type", F.lit(" "), "props")
    return e.select(
        F.col("event_id").alias("id"), (F.when(F.col("event_id") % 7 != 0, ts) if untimed else ts).alias("timestamp"), severity.alias("severity"), severity_rank(severity).alias("severity_rank"),
        F.concat(F.lit("user_"), F.col("user_id") % 10, F.lit(".log")).alias("source_file"), F.col("event_id").alias("line_number"), F.col("user_id").cast("string").alias("thread"),
        F.col("event_type").alias("component"), message.alias("message"), message.alias("raw_text"), F.lit("events").alias("profile_id"),
        (F.date_trunc("day", ts) if untimed else F.lit(None).cast("timestamp")).alias("file_modified"),
    )


def documents_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``documents``: ``source_file, doc_id, line_number, line``."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = d.select(F.col("source").alias("source_file"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("source_file", "doc_id", (F.col("pos") + 1).cast("long").alias("line_number"), "line")


def rendered(entries: DataFrame, text: Column) -> DataFrame:
    return entries.select("source_file", F.col("line_number").cast("long").alias("line_number"), text.alias("line"), "file_modified")


def ntz(df: DataFrame) -> DataFrame:
    """Times as the tables have them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.simpleString() == "timestamp"})

"""Entries near an anchor in time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS, LEAST, MOST = 30, 1, 3600


def _clamped(seconds: int) -> int:
    return min(max(seconds, LEAST), MOST)


def correlate(entries: DataFrame, anchor: datetime | None, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Entries of all files within ``seconds`` of ``anchor``, both ends included; none without an anchor time."""
    if anchor is None:
        return entries.limit(0)
    w = timedelta(seconds=_clamped(seconds))
    return entries.where(F.col("timestamp").between(F.lit(anchor - w), F.lit(anchor + w)))


def correlate_many(entries: DataFrame, anchors: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``anchor_id`` and the entry, for each row of ``anchors(id, timestamp)`` and each entry near it.

    A range join by buckets of the window's width: an anchor goes to its bucket and both neighbours, entries to their own,
    so the join is an equality (hash or merge, splittable when skewed) with the exact test on top.
    """
    w = _clamped(seconds)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(micros(c) / F.lit(w * 1_000_000))
    near = anchors.where("timestamp is not null").select(F.col("id").alias("anchor_id"), micros("timestamp").alias("t0"), F.explode(F.sequence(bucket("timestamp") - 1, bucket("timestamp") + 1)).alias("bucket"))
    timed = entries.where("timestamp is not null").withColumn("bucket", bucket("timestamp"))
    return timed.join(near, "bucket").where(F.abs(micros("timestamp") - F.col("t0")) <= w * 1_000_000).drop("bucket", "t0")


def correlate_any(entries: DataFrame, anchors: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The entries that are within ``seconds`` of any row of ``anchors(timestamp)``, each once.

    No pairs are made: of a bucket of the window's width only the first and last anchor count.  An entry is near one if its own
    bucket has an anchor, if the bucket before has one late enough, or the one behind has one early enough.  The table of these has a row a bucket,
    whatever the number of anchors, and meets the entries in an equality join.
    """
    w = _clamped(seconds) * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = F.floor(micros("timestamp") / F.lit(w))
    ends = anchors.where("timestamp is not null").groupBy(bucket.alias("bucket")).agg(F.min(micros("timestamp")).alias("first"), F.max(micros("timestamp")).alias("last"))
    none = F.lit(None).cast("long")
    sides = F.array(
        F.struct(F.col("bucket").alias("at"), F.lit(True).alias("inside"), none.alias("until"), none.alias("since")),
        F.struct((F.col("bucket") + 1).alias("at"), F.lit(False).alias("inside"), (F.col("last") + w).alias("until"), none.alias("since")),
        F.struct((F.col("bucket") - 1).alias("at"), F.lit(False).alias("inside"), none.alias("until"), (F.col("first") - w).alias("since")),
    )
    near = ends.select(F.inline(sides)).groupBy("at").agg(F.max("inside").alias("inside"), F.max("until").alias("until"), F.min("since").alias("since"))
    timed = entries.where("timestamp is not null").withColumns({"at": bucket, "micros": micros("timestamp")})
    test = F.col("inside") | F.coalesce(F.col("micros") <= F.col("until"), F.lit(False)) | F.coalesce(F.col("micros") >= F.col("since"), F.lit(False))
    return timed.join(near, "at").where(test).select(*entries.columns)

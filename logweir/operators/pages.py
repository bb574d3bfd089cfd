"""A stored timeline with an index of ranks: any page is found without sorting or counting what stands before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a file, so that a page opens little.
FILE_ROWS = 1_000_000


def timeline_order(newest_first: bool = False) -> list:
    return [F.desc_nulls_first("timestamp"), F.desc("id")] if newest_first else [F.asc_nulls_last("timestamp"), F.asc("id")]


def store_timeline(entries: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write ``entries`` in timeline order below ``path``: ranges of time and id, a file each, and a row an interval in the index.

    One range sort; ranges are disjoint, so a file's place follows from its least key, whatever the files are called.
    """
    spark = entries.sparkSession
    n = max(1, -(-entries.count() // file_rows))
    entries.repartitionByRange(n, *timeline_order()).sortWithinPartitions(*timeline_order()).write.parquet(f"{path}/rows")
    key = F.struct(F.col("timestamp").isNull().alias("untimed"), "timestamp", "id")
    stored = spark.read.schema(entries.schema).parquet(f"{path}/rows")
    files = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.min(key).alias("key"))
    # A row a file: the only rows that are ordered in one task.
    before = F.sum("rows").over(Window.orderBy("key")) - F.col("rows")
    files.select("file", "rows", before.alias("before")).write.parquet(f"{path}/index")


def timeline_rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/index").agg(F.coalesce(F.max(F.col("before") + F.col("rows")), F.lit(0))).first()[0]


def page(spark: SparkSession, path: str, at: int, rows: int, newest_first: bool = False) -> DataFrame:
    """``rows`` rows from position ``at`` (from 0) of a timeline of :func:`store_timeline`, in order.

    Only files that have a row of the page are opened: one or two, if it is shorter than a file.
    """
    if newest_first:  # the exact reverse
        end = max(0, timeline_rows(spark, path) - at)
        first, last = max(0, end - rows), end
    else:
        first, last = at, at + rows
    index = spark.read.parquet(f"{path}/index").where((F.col("before") < last) & (F.col("before") + F.col("rows") > first)).collect()
    schema = spark.read.parquet(f"{path}/rows").schema
    if not index or first >= last:
        return spark.createDataFrame([], schema)
    within = spark.read.schema(schema).parquet(*[r.file for r in index])
    # The page's rows counted from the start of the first file, or newest first from the end of the last.
    least, most = min(r.before for r in index), max(r.before + r.rows for r in index)
    skip = most - last if newest_first else first - least
    return within.orderBy(*timeline_order(newest_first)).offset(max(0, skip)).limit(min(last, most) - first)

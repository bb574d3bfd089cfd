"""A stored table of entries with an index of the letter triples in its files, so that a text search opens only files that may have a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import FIELDS, FilterSpec, apply_filters
from .pages import timeline_order

FILE_ROWS = 1_000_000
SIZE = 3


def _triples(text: Column) -> Column:
    """Distinct runs of three characters of ``text`` in lower case."""
    low = F.lower(text)
    last = F.length(low) - (SIZE - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(low, i, F.lit(SIZE))))


def store_searchable(entries: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write ``entries`` below ``path`` in timeline order, and which triples each file has.

    The index has a row for a triple and a file that has it, in the order of triples, so a search reads the few row groups of its own.
    """
    spark = entries.sparkSession
    n = max(1, -(-entries.count() // file_rows))
    entries.repartitionByRange(n, *timeline_order()).sortWithinPartitions(*timeline_order()).write.parquet(f"{path}/rows")
    stored = spark.read.schema(entries.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), *FIELDS)
    each = F.array_distinct(F.concat(*[F.coalesce(_triples(F.col(c)), F.array().cast("array<string>")) for c in FIELDS]))
    found = stored.select("file", F.explode(each).alias("triple")).distinct()
    found.repartitionByRange("triple").sortWithinPartitions("triple", "file").write.parquet(f"{path}/triples")


def files_with(spark: SparkSession, path: str, needle: str) -> list[str] | None:
    """Files of a table of :func:`store_searchable` that have every triple of ``needle``; None if it is too short to tell."""
    wanted = spark.range(1).select(_triples(F.lit(needle)).alias("t")).first().t
    if not wanted:
        return None
    hits = spark.read.parquet(f"{path}/triples").where(F.col("triple").isin(*wanted))
    return [r.file for r in hits.groupBy("file").count().where(F.col("count") == len(wanted)).select("file").collect()]


def search_stored(spark: SparkSession, path: str, spec: FilterSpec, **options) -> DataFrame:
    """:func:`.filters.apply_filters` over a stored table; a text that is looked for as it is decides which files are opened, the filter decides on rows."""
    files = files_with(spark, path, spec.text) if spec.text and not spec.fuzzy else None
    schema = spark.read.parquet(f"{path}/rows").schema
    if files is None:
        rows = spark.read.schema(schema).parquet(f"{path}/rows")
    else:
        rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return apply_filters(rows, spec, **options)

"""Finding log files and reading their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import materialize, open_file
from ..functions.text import base_name, matches_glob

# Defaults of the listing.
INCLUDE = ["*.log", "*.log.[0-9]*", "*.txt"]
EXCLUDE = ["*.gz", "*.zip", "*.bak", "*.tmp", "node_modules", ".git", "__pycache__"]
MAX_DEPTH, DEEPEST, MAX_FILES, LARGE_BYTES = 10, 50, 500, 100 * 1024 * 1024
UTF16_MARKS = (bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
#: Up to this size a file isn't worth a task or a split of its own (by Spark's measure too: opening a file costs as much as reading this).
WHOLE_BYTES = 4 * 1024 * 1024
#: Names of files that Spark's reader of texts unpacks.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def _wild(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def _few_tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


@contextmanager
def listed_by_cores(spark: SparkSession, alone: int = 32) -> Iterator[None]:
    """Meanwhile Spark lists files and folders in a few tasks a core, where its own number is a task for each, up to 10,000; ``alone`` are listed by the driver without a job."""
    key = "spark.sql.sources.parallelPartitionDiscovery."
    before = {k: spark.conf.get(key + k) for k in ("parallelism", "threshold")}
    spark.conf.set(key + "parallelism", min(int(before["parallelism"]), _few_tasks(spark)))
    spark.conf.set(key + "threshold", max(int(before["threshold"]), alone))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(key + k, v)


def list_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """``path, name, size, modified, is_large`` of the files below ``root``; ``options`` are those of :func:`select_files`.

    Contents aren't read; Spark's listing leaves out files of size 0.
    """
    with listed_by_cores(spark):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).coalesce(_few_tasks(spark))  # dealt by sizes, as if they were read
    return select_files(listed.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")), root, **options)


def below(path: Column, root: str) -> Column:
    """Names of the folders below ``root`` that lead to ``path``, and the file's."""
    top = "/" + root.split(":", 1)[-1].strip("/") if ":" in root else "/" + root.strip("/")
    return F.split(F.substr(F.regexp_replace(path, "^[a-z0-9]+:/+", "/"), F.lit(len(top.rstrip("/")) + 2)), "/")


def select_files(
    listed: DataFrame, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_depth: int = MAX_DEPTH,
    modified_since: datetime | None = None, directory_globs: bool = False,
) -> DataFrame:
    """``path, name, size, modified, is_large`` of those of ``listed(path, size, modified)`` that are wanted.

    ``include``/``exclude`` are globs on file names; an exclude without wildcards also names directories that are left
    out (with ``directory_globs`` any exclude does).
    """
    include, exclude = INCLUDE if include is None else include, EXCLUDE if exclude is None else exclude
    listed = listed.select("path", base_name(F.col("path")).alias("name"), "size", "modified", below(F.col("path"), root).alias("parts"))
    directories = [p for p in exclude if directory_globs or not _wild(p)]
    keep = F.size("parts") <= min(max_depth, DEEPEST)
    if include:
        keep &= matches_glob(F.col("name"), include)
    if exclude:
        keep &= ~matches_glob(F.col("name"), exclude)
    if directories:
        keep &= ~F.exists(F.slice("parts", 1, F.size("parts") - 1), lambda d: matches_glob(d, directories))
    if modified_since is not None:
        keep &= F.col("modified").isNull() | (F.col("modified") >= F.lit(modified_since))
    return listed.where(keep).select("path", "name", "size", "modified", (F.col("size") >= LARGE_BYTES).alias("is_large"))


def newest(files: DataFrame, most: int = MAX_FILES) -> tuple[DataFrame, int]:
    """The ``most`` newest files, and how many there were (a larger number means a cut to warn of)."""
    return files.orderBy(F.desc_nulls_last("modified"), "path").limit(most), files.count()


def not_loaded(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files whose path isn't in ``loaded(path)``: what an appended scan reads."""
    return files.join(loaded.select("path").distinct(), "path", "left_anti")


def mark_chosen(files: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Add ``parsing_skipped``: true for files that aren't in ``chosen(path)``; None chooses all."""
    if chosen is None:
        return files.withColumn("parsing_skipped", F.lit(False))
    flagged = chosen.select("path").distinct().withColumn("chosen", F.lit(True))
    return files.join(flagged, "path", "left").withColumn("parsing_skipped", F.col("chosen").isNull()).drop("chosen")


def search_files(query: str) -> Column:
    """A test on ``name``: comma-separated tokens, one of which fits; a token with ``*`` or ``?`` is a glob, any other a substring."""
    found = F.lit(False)
    tokens = [t.strip().lower() for t in query.split(",") if t.strip()]
    for t in tokens:
        found |= matches_glob(F.col("name"), [t], ignore_case=True) if "*" in t or "?" in t else F.contains(F.lower("name"), F.lit(t))
    return found if tokens else F.lit(True)


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """``source_file, line_number, line, file_modified`` of text files, one row a line, numbered from 1.

    Files that begin with a UTF-16 byte order mark are decoded whole, as they can't be split; all others are UTF-8, with or without
    a mark, invalid bytes replaced, and are read in splits, also a single huge one.
    """
    # A split's rows have consecutive marks in the order of its lines, and both reads have the same splits, so a line's number is its
    # distance from the split's first mark plus the lines of the splits before.  Those counts are a row a split.
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive).text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_modification_time").alias("file_modified"),
        F.monotonically_increasing_id().alias("mark"), "value",
    )
    marked = (F.col("at") == 0) & F.substring(F.col("value").cast("binary"), 1, 2).isin(*UTF16_MARKS)
    splits = raw.groupBy("source_file", "at").agg(F.min("mark").alias("first"), F.count("*").alias("n"), F.min_by(marked, "mark").alias("wide"))
    splits = materialize(splits, "splits")
    by_file = Window.partitionBy("source_file")
    splits = splits.select("source_file", "at", "first", (F.sum("n").over(by_file.orderBy("at")) - F.col("n")).alias("before"), F.max("wide").over(by_file).alias("wide"))
    number = F.col("mark") - F.col("first") + 1 + F.col("before")
    line = F.make_valid_utf8(F.regexp_replace("value", "\r$", ""))
    narrow = raw.join(splits.where(~F.col("wide")), ["source_file", "at"]).select("source_file", number.alias("line_number"), line.alias("line"), "file_modified")
    narrow = narrow.withColumn("line", F.when(F.col("line_number") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
    wide = [r.source_file for r in splits.where("wide").select("source_file").distinct().collect()]  # names of files that the driver has listed
    return narrow.unionByName(read_utf16_lines(spark, wide)) if wide else narrow


def read_files(files: DataFrame) -> DataFrame:
    """:func:`read_lines` of the files that ``files(path, size, modified)`` names, any number of them: names don't pass through the driver.

    Files of up to ``WHOLE_BYTES`` are read whole, in the tasks that ``files`` has; the names of the larger and of packed ones, which are few for their size,
    go to Spark's reader.  Stores are those that Arrow knows.
    """
    other = F.coalesce(F.col("size") > WHOLE_BYTES, F.lit(True)) | F.rlike("path", F.lit(PACKED))
    names = [r.path for r in files.where(other).select("path").collect()]
    return read_some(files.where(~other), names)


def by_reader(files: pa.Table) -> tuple[pa.Table, list[str]]:
    """Of ``files(path, size, modified)`` on the driver those that are read whole, and the names of others."""
    other = [size is None or size > WHOLE_BYTES or bool(re.search(PACKED, path)) for path, size in zip(files["path"].to_pylist(), files["size"].to_pylist())]
    return files.filter(pa.array([not x for x in other], pa.bool_())), files["path"].filter(pa.array(other, pa.bool_())).to_pylist()


def read_some(whole: DataFrame, others: list[str]) -> DataFrame:
    """The lines of the files ``whole(path, modified)``, each read at once, and of ``others``, read by Spark."""
    content = whole.select("path", "modified").mapInArrow(_contents, "path string, modified timestamp, content binary")
    some = content.where("content NOT IN (x'', x'EFBBBF')")
    lines = _numbered(some, "if(substring(content, 1, 2) IN (x'FFFE', x'FEFF'), decode(content, 'UTF-16'), make_valid_utf8(regexp_replace(CAST(content AS string), '^\ufeff{1,2}', '')))")
    if not others:
        return lines
    names = sorted(re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in others)  # else they are patterns
    named = F.url_decode(F.replace("source_file", F.lit("+"), F.lit("%2B")))  # Spark's metadata have names as in a URL
    return lines.unionByName(read_lines(whole.sparkSession, names).withColumn("source_file", named))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``content`` to ``path, modified``, some megabytes a batch, in the tasks."""
    stores: dict = {}
    for b in batches:
        held, size = [], 0
        for i, path in enumerate(b.column("path").to_pylist(), 1):
            with open_file(path, stores) as f:
                held.append(f.read())
            size += len(held[-1])
            if size >= WHOLE_BYTES or i == b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.slice(i - len(held), len(held)).columns, pa.array(held, pa.binary())], ["path", "modified", "content"])
                held, size = [], 0


def _numbered(files: DataFrame, text: str) -> DataFrame:
    """The lines of ``text``, SQL for the decoded content of each of ``files(path, modified, ...)``: a batch of new files is planned in half the time of columns."""
    lines = files.selectExpr("path AS source_file", "modified AS file_modified", f"posexplode(split(regexp_replace({text}, '\\n\\\\z', ''), '\\n')) AS (i, line)")
    return lines.selectExpr("source_file", "i + 1L AS line_number", "regexp_replace(line, '\\r$', '') AS line", "file_modified")


def utf16_lines(files: DataFrame) -> DataFrame:
    """Lines of ``files(path, content, modified)`` whose content begins with a UTF-16 byte order mark."""
    own = files.where(F.substring("content", 1, 2).isin(*UTF16_MARKS))
    return _numbered(own, "decode(content, 'UTF-16')")


def read_utf16_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of the files that begin with a UTF-16 byte order mark; each is decoded whole, as such files can't be split."""
    return utf16_lines(spark.read.format("binaryFile").load(paths).select("path", "content", F.col("modificationTime").alias("modified")))

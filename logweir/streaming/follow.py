"""Streaming jobs over lines and entries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize, readable
from ..functions.text import matches_glob, normalize_message
from ..operators.detect import detect_formats
from ..operators.parse import only_errors, parse_all, parse_lines
from ..sources.files import EXCLUDE, INCLUDE, below, by_reader, newest, read_lines, read_some
from ..sources.profiles import Profile

TAIL_FILES, NEW_FILES = 100, 1000


def tail_candidates(files: DataFrame, most: int = TAIL_FILES) -> DataFrame:
    """The newest files, as many as a follower takes."""
    return newest(files, most)[0]


def parse_batch(lines: DataFrame, profile: Profile, now: datetime, errors_only: bool = False) -> DataFrame:
    """Entries of a micro-batch: continuation lines before its first entry are dropped, entries without a time get ``now``."""
    return _live(parse_lines(lines, profile, now), now, errors_only)


def _live(entries: DataFrame, now: datetime, errors_only: bool) -> DataFrame:
    entries = entries.withColumn("timestamp", F.coalesce("timestamp", F.lit(now)))
    return only_errors(entries) if errors_only else entries


def follow(lines: DataFrame, profile: Profile, sink: Callable[[DataFrame, int], None], checkpoint: str, clock: Callable[[], datetime], errors_only: bool = False, trigger: dict | None = None):
    """Start a query that parses each micro-batch and gives the entries to ``sink(entries, batch_id)``.

    After a failure a batch may be given again, with the same id: sinks of :mod:`.live` put it in its own place.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(parse_batch(batch, profile, clock(), errors_only), batch_id)

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def watch_new_files(
    spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, modified_since: datetime | None = None, most: int = NEW_FILES
) -> DataFrame:
    """A stream of the files that appear below ``root``: ``path, modified, size``, ``most`` a batch; contents aren't read, and Spark's log of seen
    files remembers the known ones.

    Every exclude applies to file names and to directory names.
    """
    include, exclude = INCLUDE if include is None else include, EXCLUDE if exclude is None else exclude
    schema = "path string, modificationTime timestamp, length long, content binary"  # what the format has; content isn't asked for
    listed = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).load(root)
    parts = below(F.col("path"), root)
    keep = F.lit(True)
    if include:
        keep &= matches_glob(F.element_at(parts, -1), include)
    if exclude:
        keep &= ~F.exists(parts, lambda d: matches_glob(d, exclude))
    if modified_since is not None:
        keep &= F.col("modificationTime").isNull() | (F.col("modificationTime") >= F.lit(modified_since))
    return listed.where(keep).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def lines_of_files(files: DataFrame) -> DataFrame | None:
    """The numbered, decoded lines of a batch of :func:`watch_new_files`; None without files.

    Only names pass through the driver, as many as a batch has; small files are read whole, large ones in splits, or whole if they are UTF-16.
    """
    # A batch is listed anew for each action; what is read is what was listed first.
    listed = files.select("path", "modified", "size").coalesce(files.sparkSession.sparkContext.defaultParallelism).toArrow()
    paths = listed.column("path").to_pylist()
    if not paths:
        return None
    if not readable(paths):
        return read_lines(files.sparkSession, sorted(paths))
    whole, others = by_reader(listed)
    return read_some(files.sparkSession.createDataFrame(whole), others)


def follow_new_files(
    files: DataFrame, profiles: list[Profile], sink: Callable[[DataFrame, int], None], checkpoint: str, clock: Callable[[], datetime], errors_only: bool = False, trigger: dict | None = None
):
    """Start a query that reads each batch of new files, finds out each file's format, parses it, and gives the entries to ``sink``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # A batch is listed anew for each action; what is parsed is what was listed first.
        files = materialize(batch, "new-files")
        lines = lines_of_files(files)
        if lines is not None:
            now = clock()
            found = materialize(detect_formats(lines, files, profiles), "formats")
            sink(_live(parse_all(lines, found, profiles, now), now, errors_only), batch_id)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def streaming_dedup(entries: DataFrame, normalized: bool = True, watermark: str | None = None) -> DataFrame:
    """Per (file, message) the count, the first time and the latest row so far; write it in update mode.  A watermark bounds the state."""
    if watermark:
        entries = entries.withWatermark("timestamp", watermark)
    key = normalize_message(F.col("message")) if normalized else F.col("message")
    return entries.groupBy("source_file", key.alias("key")).agg(
        F.count("*").alias("count"), F.min("timestamp").alias("first_timestamp"), F.max_by("message", "timestamp").alias("message"), F.max("timestamp").alias("timestamp")
    )


def severity_per_minute(entries: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """An extension: tumbling counts of severities."""
    w = F.window("timestamp", "1 minute")
    return entries.withWatermark("timestamp", watermark).groupBy(w, "severity").count().select(F.col("window.start").alias("minute"), "severity", F.col("count").alias("n"))


def rolling_changes(entries: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """``at, severity, change``: by how much the number of entries of the last ``seconds`` changes at each full second, as a stream.

    An entry enters at the first full second that isn't before it and leaves ``seconds`` after the one that isn't behind it, plus one.  The state is a sum a
    second and severity, whatever the number of entries; seconds that no late entry can reach any more leave it.
    Write it in update mode (the newest row of a second counts) or in append mode (a second once it is final).
    """
    timed = entries.where("timestamp is not null").withColumns({"floor": F.date_trunc("second", "timestamp")})
    second = F.make_dt_interval(secs=F.lit(1))
    enters = F.when(F.col("floor") == F.col("timestamp"), F.col("floor")).otherwise(F.col("floor") + second)
    leaves = F.col("floor") + F.make_dt_interval(secs=F.lit(seconds + 1))
    both = timed.select("severity", F.explode(F.array(F.struct(enters.alias("at"), F.lit(1).alias("step")), F.struct(leaves.alias("at"), F.lit(-1).alias("step")))).alias("c"))
    # Leaving times run ahead of the entries by the length of the window.
    marked = both.select("severity", F.col("c.at").alias("at"), F.col("c.step").alias("step")).withWatermark("at", f"{seconds + 1} seconds {late}")
    return marked.groupBy("at", "severity").agg(F.sum("step").alias("change"))


def rolling_counts(changes: DataFrame, clocks: list[datetime]) -> DataFrame:
    """``clock, severity, n``: the entries of the window at each of ``clocks`` (full seconds), from the stored rows of :func:`rolling_changes`."""
    sums = [F.sum(F.when(F.col("at") <= F.lit(c), F.col("change"))).alias(f"c{i}") for i, c in enumerate(clocks)]
    wide = changes.groupBy("severity").agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("clock"), F.col(f"c{i}").alias("n")) for i, c in enumerate(clocks)])).alias("x")
    return wide.select("severity", each).select("x.clock", "severity", "x.n").where(F.col("n") > 0)

"""Stored tables that grow batch by batch: the ring of the last entries, and a filtered view in timeline order.

Both are a folder of segments.  A segment is a Parquet folder and a small manifest file that is written when the data is complete; readers
take only segments that have one.  A segment's name holds the number of its batch, so a batch that is given again after a failure
replaces itself, and its ids are those it had: they follow from the segments before it.  Manifests have counts and bounds, so
readers open no data that they don't need.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from datetime import datetime

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import open_folder
from ..operators.filters import FilterSpec, apply_filters
from ..operators.parse import assign_ids

RING_ROWS, FAN_IN = 50_000, 8


@dataclass(frozen=True)
class Segment:
    """Batches ``first`` to ``last``; ids below ``next_id``; times in microseconds, none for a segment without timed rows."""

    first: int
    last: int
    folder: str
    rows: int
    next_id: int
    earliest: int | None
    latest: int | None

    @property
    def name(self) -> str:
        return f"{self.first:012d}-{self.last:012d}.json"


class Segments:
    """The segments of a folder that Spark's tasks and the driver share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.dropped: list[Segment] = []

    def all(self) -> list[Segment]:
        """Complete segments in batch order.  A merged segment stands for those that lie within it, which may still be there."""
        fs, at = open_folder(f"{self.folder}/manifests")
        names = [f.path for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.type == FileType.File and f.base_name.endswith(".json")]
        found = []
        for name in names:
            try:
                with fs.open_input_file(name) as f:
                    found.append(Segment(**json.loads(f.read())))
            except (FileNotFoundError, ValueError):  # taken away by a merge, or not yet complete
                continue
        kept: list[Segment] = []
        for s in sorted(found, key=lambda s: (s.first, -s.last)):
            if not kept or s.last > kept[-1].last:
                kept.append(s)
        return kept

    def write(self, rows: DataFrame, first: int, last: int, next_id: int) -> Segment:
        """Write a segment; ``rows`` are written once, and counted from what was written."""
        folder = f"{self.folder}/data/{first:012d}-{last:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        micros = F.unix_micros("timestamp")
        done = self.spark.read.schema(rows.schema).parquet(folder).agg(F.count("*").alias("n"), F.max("id").alias("id"), F.min(micros).alias("a"), F.max(micros).alias("b")).first()
        segment = Segment(first, last, folder, done.n, max(next_id, -1 if done.id is None else done.id + 1), done.a, done.b)
        fs, at = open_folder(f"{self.folder}/manifests")
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{segment.name}") as f:
            f.write(json.dumps(asdict(segment)).encode())
        return segment

    def drop(self, segments: list[Segment]) -> None:
        """Take segments out of the table.  Their data goes with the next call, for readers that have just listed them."""
        for s in segments:
            fs, at = open_folder(f"{self.folder}/manifests")
            fs.delete_file(f"{at}/{s.name}")
        for s in self.dropped:
            fs, at = open_folder(s.folder)
            fs.delete_dir(at)
        self.dropped = list(segments)

    def clean(self) -> int:
        """Delete data that no manifest names, as stopped writers leave it; with no writer and no reader at work.  Returns how many folders."""
        fs, at = open_folder(f"{self.folder}/data")
        named = {s.folder.rsplit("/", 1)[1] for s in self.all()}
        left = [f.path for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.base_name not in named]
        for path in left:
            fs.delete_dir(path)
        return len(left)

    def read(self, segments: list[Segment], schema) -> DataFrame:
        folders = [s.folder for s in segments if s.rows]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


class RingTable:
    """The last ``most`` followed entries; rows of a scan live in a table of their own and are never evicted.

    Ids go on from ``first_id`` and are never given twice.  Whole segments are dropped once the others hold ``most`` rows, so a batch costs
    what it adds, not what the table holds.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = RING_ROWS, first_id: int = 0) -> None:
        self.segments, self.most, self.first_id = Segments(spark, folder), most, first_id

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """A sink of :func:`.follow.follow`; the same batch again is no other rows."""
        there = self.segments.all()
        if any(s.last >= batch_id for s in there):
            return  # given again, and complete
        start = max([self.first_id, *(s.next_id for s in there)])
        new = self.segments.write(assign_ids(batch.drop("id"), start), batch_id, batch_id, start)
        there.append(new)
        left, old = sum(s.rows for s in there), []
        for s in there[:-1]:
            if left - s.rows < self.most:
                break
            left -= s.rows
            old.append(s)
        self.segments.drop(old)

    def read(self, schema) -> DataFrame:
        """The last ``most`` rows; ids are consecutive, so they are those above a bound."""
        there = self.segments.all()
        end = max([self.first_id, *(s.next_id for s in there)])
        return self.segments.read(there, schema).where(F.col("id") >= end - self.most)


class LiveView:
    """What a filter lets through of all batches so far, kept in runs that are sorted by time and id.

    A batch is filtered on its own and becomes a run, late rows in it or not.  Of each ``FAN_IN`` neighbours of like size one sorted run
    is made, so a row is rewritten a number of times that grows with the logarithm of the table, and nothing is sorted
    as a whole again.  A reader of a stretch of time opens the runs that have some of it.

    Bounds that move with the clock (``last_seconds``) apply on reading.  What depends on other rows, dedup or bookmarks, is done on the result.
    """

    def __init__(self, spark: SparkSession, folder: str, spec: FilterSpec, fan_in: int = FAN_IN) -> None:
        if spec.bookmarked or spec.active_seconds is not None:
            raise ValueError("bookmarks and the activity of files change afterwards: filter the view by them")
        self.segments, self.spec, self.fan_in = Segments(spark, folder), spec, fan_in

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        order = [F.asc_nulls_last("timestamp"), F.asc("id")]
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """A sink for entries with ids; the same batch again changes nothing."""
        there = self.segments.all()
        if any(s.last >= batch_id for s in there):
            return
        self.segments.write(self._sorted(apply_filters(batch, replace(self.spec, last_seconds=None))), batch_id, batch_id, 0)

    def merge(self, schema) -> bool:
        """Make one run of ``fan_in`` neighbours of like size, if there are such; between batches or beside them."""
        there = self.segments.all()
        size = lambda s: max(s.rows, 1).bit_length() // max(1, self.fan_in.bit_length() - 1)
        for i in range(len(there) - self.fan_in + 1):
            part = there[i : i + self.fan_in]
            if len({size(s) for s in part}) == 1:
                self.segments.write(self._sorted(self.segments.read(part, schema)), part[0].first, part[-1].last, 0)
                self.segments.drop(part)
                return True
        return False

    def read(self, schema, as_of: datetime | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Rows of the view, of ``start`` to ``end`` if given (rows without a time only if neither is); :func:`.analyse.timeline` puts them in order."""
        micros = lambda t: round(t.timestamp() * 1_000_000)
        if self.spec.last_seconds is not None and as_of is None:
            raise ValueError("a filter that moves with the clock needs as_of")
        there = self.segments.all()
        if start is not None:
            there = [s for s in there if s.latest is not None and s.latest >= micros(start)]
        if end is not None:
            there = [s for s in there if s.earliest is not None and s.earliest <= micros(end)]
        rows = self.segments.read(there, schema)
        if start is not None:
            rows = rows.where(F.col("timestamp") >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col("timestamp") <= F.lit(end))
        return rows if self.spec.last_seconds is None else apply_filters(rows, FilterSpec(last_seconds=self.spec.last_seconds), as_of)

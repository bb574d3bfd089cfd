"""Following files that grow: a Python streaming source whose offsets survive a restart.

Spark's file source takes files as complete and never sees appended bytes.  Here a batch is a byte range of each file that grew, a
partition each.  Ranges end behind line breaks, so nothing is looked back for and every byte of a complete line is read once by a
task.  The driver looks for the last line break of what it plans, from the end and in small blocks.

An offset has for each path:

* ``turn``: how often the file became shorter and was begun again;
* ``at``: the start of the first line that isn't delivered;
* ``seen``: where the search for its end stands (``at`` unless a line is open that fills all that may be read at once);
* ``skip``: whether ``at`` lies within a line that is too long.

A line of more than ``LONGEST_LINE`` bytes is dropped, and only it.  A step takes ``PER_FILE_BYTES`` of a file at most, or one longer line.

Restarts: each planned offset is written to ``positions``, a folder of the query's own beside its checkpoint, before Spark learns of it.  Spark
asks for the next one when it has the last in its log, which is noted too.  A new reader plans on from an offset that is in the log; one that may
not be there it first offers again, exactly as it was.
So no range begins before the place where the last one ended, whether the planned batch had run or not, and no
first batch is larger than others.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.storage import open_folder

PER_FILE_BYTES, LONGEST_LINE = 512 * 1024, 2 * 1024 * 1024
SCHEMA = "source_file string, line_number bigint, line string, file_modified timestamp"
BLOCK, KEPT = 16 * 1024, 2


class Range(InputPartition):
    """Complete lines of a file: bytes ``start`` to ``end``; ``skip`` leaves out the rest of a line that is too long."""

    def __init__(self, path: str, start: int, end: int, skip: bool) -> None:
        self.path, self.start, self.end, self.skip = path, start, end, skip


def _size(path: str) -> int:
    return os.path.getsize(path) if os.path.exists(path) else 0


def _place(at: int, turn: int = 0, seen: int | None = None, skip: bool = False) -> dict:
    return {"turn": turn, "at": at, "seen": at if seen is None else seen, "skip": skip}


def _last_break(path: str, start: int, end: int) -> int:
    """Behind the last line break of these bytes, ``start`` if they have none."""
    with open(path, "rb") as f:
        while end > start:
            begin = max(start, end - BLOCK)
            f.seek(begin)
            found = f.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return start


def _first_break(path: str, start: int, end: int) -> int:
    """Behind the first line break of these bytes, 0 if they have none."""
    with open(path, "rb") as f:
        f.seek(start)
        while start < end:
            block = f.read(min(BLOCK, end - start))
            if not block:
                break
            found = block.find(b"\n")
            if found >= 0:
                return start + found + 1
            start += len(block)
    return 0


def advance(path: str, place: dict, most: int) -> dict:
    """The place after the next step in a file, the same one if no line was completed and nothing more can be searched."""
    size, turn, at, seen, skip = _size(path), place["turn"], place["at"], place["seen"], place["skip"]
    if size < seen:
        turn, at, seen, skip = turn + 1, 0, 0, False
    end = min(size, seen + most)
    if end <= seen:
        return _place(at, turn, seen, skip)
    if seen == at and not skip:
        found = _last_break(path, at, end)
        if found > at:
            return _place(found, turn)
        # A line that fills the whole step is open; one that merely isn't finished is looked at again.
        return _place(at, turn, end if end - at >= most else at)
    found = _first_break(path, seen, end)
    if skip:
        return _place(found, turn) if found else _place(end, turn, skip=True)
    if found:
        return _place(found, turn)
    return _place(end, turn, skip=True) if end - at > LONGEST_LINE else _place(at, turn, end)


class Positions:
    """Planned offsets in a folder, the latest ones kept; a file each, as object stores can't replace one in part."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def names(self, prefix: str = "planned-") -> list[str]:
        fs, folder = open_folder(self.folder)
        return sorted(f.base_name for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.base_name.startswith(prefix))

    def read(self, name: str) -> dict | None:
        fs, folder = open_folder(self.folder)
        try:
            with fs.open_input_file(f"{folder}/{name}") as f:
                return json.loads(f.read())
        except (FileNotFoundError, ValueError):  # absent, or its writer was stopped in the middle
            return None

    def write(self, name: str, offset: dict) -> None:
        fs, folder = open_folder(self.folder)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}") as f:
            f.write(json.dumps(offset).encode())

    def last(self) -> tuple[int, dict | None]:
        for name in reversed(self.names()):
            offset = self.read(name)
            if offset is not None:
                return int(name[8:-5]), offset
        return 0, None

    def plan(self, number: int, offset: dict, kept: int = KEPT) -> None:
        self.write(f"planned-{number:012d}.json", offset)
        fs, folder = open_folder(self.folder)
        for name in self.names()[:-kept]:
            fs.delete_file(f"{folder}/{name}")


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.first = json.loads(options.get("offsets", "{}"))
        self.most = int(options.get("bytesPerFile", PER_FILE_BYTES))
        self.positions = Positions(options["positions"])
        self.number, self.last = self.positions.last()
        taken = (self.positions.read("taken.json") or {}).get("number")
        #: Whether Spark may not have the last planned offset; and the number of one that this reader offered.
        self.owed, self.offered = self.last is not None and taken != self.number, None

    def initialOffset(self) -> dict:
        """Where the query began, the same whenever it is asked for."""
        begun = self.positions.read("initial.json")
        if begun is None:
            begun = {p: _place(self.first.get(p, _size(p))) for p in self.paths}
            self.positions.write("initial.json", begun)
        return begun

    def latestOffset(self) -> dict:
        if self.owed:
            self.owed, self.offered = False, self.number
            return self.last
        if self.offered is not None:  # asked again, so Spark has it
            self.positions.write("taken.json", {"number": self.offered})
            self.offered = None
        last = self.last or self.initialOffset()
        now = dict(last)
        for p in self.paths:
            # A path that joins the query later begins at its present end, or where it is told to.
            try:
                now[p] = advance(p, last[p], self.most) if p in last else _place(self.first.get(p, _size(p)))
            except FileNotFoundError:  # taken away in this moment; the next step sees an empty file
                continue
        if now != last or self.last is None:
            self.number += 1
            self.positions.plan(self.number, now)
            self.offered = self.number
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        found = []
        for p, b in end.items():
            a = start.get(p)
            if a is None or b["skip"] or (b["turn"], b["at"]) <= (a["turn"], a["at"]):
                continue  # new to the query, within a line that is too long, or nothing to deliver
            again = b["turn"] > a["turn"]
            if b["at"] > (0 if again else a["at"]):
                found.append(Range(p, 0 if again else a["at"], b["at"], a["skip"] and not again))
        return found

    def read(self, part: Range) -> Iterator[tuple]:
        if not os.path.exists(part.path):
            return  # taken away since it was planned, and its lines with it
        modified = datetime.fromtimestamp(os.path.getmtime(part.path), timezone.utc)
        number, rest, dropping = 0, b"", part.skip
        with open(part.path, "rb") as f:
            f.seek(part.start)
            left = part.end - part.start
            while left > 0 and (block := f.read(min(1 << 20, left))):
                left -= len(block)
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if not dropping and len(line) <= LONGEST_LINE:
                        number += 1
                        yield part.path, number, line.removesuffix(b"\r").decode("utf-8", "replace"), modified
                    dropping = False
                if len(rest) > LONGEST_LINE:
                    rest, dropping = b"", True


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_source(spark: SparkSession, paths: list[str], positions: str, offsets: dict[str, int] | None = None, bytes_per_file: int = PER_FILE_BYTES) -> DataFrame:
    """A stream of the lines that are appended to ``paths``, from ``offsets`` (sizes at scan time) or the present ends.

    ``positions`` is a folder of this query's own, beside its checkpoint; with both, a query that is started again goes on where it was.
    """
    spark.dataSource.register(TailSource)
    options = {"paths": json.dumps(paths), "offsets": json.dumps(offsets or {}), "positions": positions, "bytesPerFile": str(bytes_per_file)}
    return spark.readStream.format("tail").options(**options).load()

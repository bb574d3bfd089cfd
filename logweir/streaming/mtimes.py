"""Modification times of known files, polled a few at a time: a Python streaming source of those that changed.

A round looks at ``FILES_A_ROUND`` files from a cursor on, so each poll costs the same however many files there are, and all of them are looked at
over several rounds.  A file that is seen for the first time only sets what later rounds compare with.

Offsets are numbers of rounds.  What a round found is written to ``positions`` before Spark learns of the round, so a query that is
started again gives a round's changes exactly as they were, and goes on at the cursor.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .tail import Positions

FILES_A_ROUND, KEPT = 200, 50


class Changes(InputPartition):
    def __init__(self, rows: list[tuple[str, int]]) -> None:
        self.rows = rows


class MtimeReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.most = int(options.get("filesPerRound", FILES_A_ROUND))
        self.store = Positions(options["positions"])
        self.round, last = self.store.last()
        at = self.store.read("cursor.json") or {"round": 0, "cursor": 0}
        self.cursor = last["cursor"] if last and self.round > at["round"] else at["cursor"]
        self.seen: dict[str, int] = {}
        for name in self.store.names("slice-"):
            self.seen |= self.store.read(name) or {}
        if last:
            self.seen |= last["seen"]  # its slice may not have been written

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        """Look at the next files; a round without a change is no new offset, but moves the cursor."""
        if self.cursor >= len(self.paths):
            self.cursor = 0
        begin, end = self.cursor, min(self.cursor + self.most, len(self.paths))
        looked: dict[str, int] = {}
        changed = []
        for p in self.paths[begin:end]:
            try:
                at = os.stat(p).st_mtime_ns // 1000
            except OSError:
                continue  # looked at again the next time round
            looked[p] = at
            if self.seen.get(p, at) != at:
                changed.append((p, at))
        self.cursor = 0 if end >= len(self.paths) else end
        if changed:
            self.round += 1
            self.store.plan(self.round, {"cursor": self.cursor, "seen": looked, "changed": changed}, KEPT)
        if changed or any(p not in self.seen for p in looked):
            self.store.write(f"slice-{begin:012d}.json", looked)
        self.store.write("cursor.json", {"round": self.round, "cursor": self.cursor})
        self.seen |= looked
        return {"round": self.round}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        found = []
        for n in range(start["round"] + 1, end["round"] + 1):
            planned = self.store.read(f"planned-{n:012d}.json")
            if planned is None:
                raise ValueError(f"round {n} is no longer in {self.store.folder}")
            found.append(Changes([tuple(x) for x in planned["changed"]]))
        return found

    def read(self, part: Changes) -> Iterator[tuple]:
        for path, at in part.rows:
            yield path, datetime.fromtimestamp(at // 1_000_000, timezone.utc).replace(microsecond=at % 1_000_000)


class MtimeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtimes"

    def schema(self) -> str:
        return "path string, modified timestamp"

    def streamReader(self, schema) -> MtimeReader:
        return MtimeReader(self.options)


def mtime_source(spark: SparkSession, paths: list[str], positions: str, files_per_round: int = FILES_A_ROUND) -> DataFrame:
    """A stream of ``path, modified`` of those of ``paths`` whose modification time changed; :func:`.analyse.refresh_modified` takes a batch of it.

    ``positions`` is a folder of this query's own.  The trigger's interval is that of the rounds.
    """
    spark.dataSource.register(MtimeSource)
    options = {"paths": json.dumps(paths), "positions": positions, "filesPerRound": str(files_per_round)}
    return spark.readStream.format("mtimes").options(**options).load()

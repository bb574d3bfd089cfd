import json
import os
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logweir.sources.files import list_files
from logweir.sources.profiles import builtin_profiles
from logweir.streaming import follow, mtimes, tail

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
LOG4J = next(p for p in builtin_profiles() if p.id == "log4j-default")


@pytest.fixture
def reader(tmp_path):
    """Readers of one query: each call is a new one, as after a restart."""
    return lambda *paths, **options: tail.TailReader({"paths": json.dumps([str(p) for p in paths]), "positions": str(tmp_path / "positions"), **options})


def lines_of(r, a, b):
    return [row[2] for part in r.partitions(a, b) for row in r.read(part)]


def drained(r, a):
    """All lines from offset ``a`` on, and the offset behind them."""
    got = []
    while (b := r.latestOffset()) != a:
        got += lines_of(r, a, b)
        a = b
    return got, a


def test_offsets(tmp_path, reader):
    f = tmp_path / "a.log"
    f.write_bytes(b"1\n2\n3\n")
    r = reader(f)
    a = r.initialOffset()
    f.open("ab").write("4\n5é".encode())
    b = r.latestOffset()
    assert lines_of(r, a, b) == ["4"]
    f.open("ab").write(b"x\n")
    c = r.latestOffset()
    assert lines_of(r, b, c) == ["5éx"]
    f.write_bytes(b"new\n")
    d = r.latestOffset()
    assert lines_of(r, c, d) == ["new"]
    f.unlink()
    e = r.latestOffset()
    f.write_bytes(b"again\n")
    assert lines_of(r, d, e) == [] and lines_of(r, e, r.latestOffset()) == ["again"]


def test_a_long_line_costs_only_itself(tmp_path, reader, monkeypatch):
    """Neither what stands before it nor the complete lines behind it are lost, however long it is; bytes are read once."""
    f = tmp_path / "a.log"
    f.write_bytes(b"")
    r = reader(f)
    a, got, read, sizes = r.initialOffset(), [], Counter(), []
    f.write_bytes(b"first\n" + b"x" * (3 * tail.LONGEST_LINE) + b"\n" + b"".join(b"line %d\n" % i for i in range(200_000)) + b"y" * (tail.LONGEST_LINE - 5) + b"\nlast\nopen")
    while (b := r.latestOffset()) != a:
        for p in r.partitions(a, b):
            read.update(range(p.start, p.end, 1000))
            sizes.append(p.end - p.start)
            got += [row[2] for row in r.read(p)]
        a = b
    assert got == ["first", *[f"line {i}" for i in range(200_000)], "y" * (tail.LONGEST_LINE - 5), "last"]
    assert max(read.values()) == 1 and sum(s > tail.PER_FILE_BYTES for s in sizes) == 1
    f.open("ab").write(b" line\n")
    assert drained(r, a)[0] == ["open line"]


def test_bytes_per_file(tmp_path, reader):
    f = tmp_path / "a.log"
    f.write_bytes(b"")
    r = reader(f, bytesPerFile="8")
    a = r.initialOffset()
    f.write_bytes(b"aaa\nbbb\nccc\nlonger than eight\nd\n")
    b = r.latestOffset()
    assert lines_of(r, a, b) == ["aaa", "bbb"]
    assert drained(r, b)[0] == ["ccc", "longer than eight", "d"]


@pytest.mark.parametrize("offsets", [{}, {"offsets": 0}])
def test_a_new_reader_goes_on_where_the_last_one_was(tmp_path, reader, offsets):
    """At whatever point the query stopped: no line twice, none lost, no batch larger than others."""
    f = tmp_path / "a.log"
    f.write_bytes(b"old\n")
    options = {"bytesPerFile": "64"} | ({"offsets": json.dumps({str(f): 0})} if offsets else {})
    r = reader(f, **options)
    log, done, got, n = [r.initialOffset()], 0, [], 0
    for step in range(60):
        f.open("ab").write(b"".join(b"line %d\n" % (n + i) for i in range(7)))
        n += 7
        if step % 7 == 3:
            f.open("ab").write(b"z" * 200 + b"\n")  # longer than a step
        b = r.latestOffset()
        crash = step % 5
        if crash == 1:  # planned, and Spark stopped before it wrote its log
            r = reader(f, **options)
            continue
        if b != log[-1]:
            log.append(b)
        if crash == 2:  # logged, and not run: the batch is given again to a new reader
            r = reader(f, **options)
        for a, b in zip(log[done:], log[done + 1 :]):
            parts = r.partitions(a, b)
            assert all(p.end - p.start <= 264 for p in parts)
            got += [row[2] for p in parts for row in r.read(p)]
        done = len(log) - 1
        if crash == 3:  # run, and committed
            r = reader(f, **options)
    got += drained(r, log[-1])[0]
    want = [x for x in f.read_text().splitlines() if offsets or x != "old"]
    assert got == want


def test_paths_that_join_later(tmp_path, reader):
    f, g = tmp_path / "a.log", tmp_path / "b.log"
    f.write_bytes(b"1\n"), g.write_bytes(b"not this\n")
    r = reader(f)
    a = r.initialOffset()
    b = r.latestOffset()
    r = reader(f, g)
    assert r.latestOffset() == b
    c = r.latestOffset()
    g.open("ab").write(b"this\n")
    assert lines_of(r, b, c) == [] and drained(r, c)[0] == ["this"] and a == b


def test_follow(spark, tmp_path):
    """A query that is stopped and started again on its checkpoint."""
    f = tmp_path / "a.log"
    f.write_text("2024-01-15 14:30:22,123 ERROR [m] a.B - old\n")
    size, got = os.path.getsize(f), []

    def run():
        stream = tail.tail_source(spark, [str(f)], str(tmp_path / "positions"), {str(f): size})
        q = follow.follow(stream, LOG4J, lambda e, i: got.extend(e.collect()), str(tmp_path / "cp"), lambda: NOW, errors_only=True, trigger={"processingTime": "0 seconds"})
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    f.open("a").write("  orphan\n2024-01-15 14:30:23,123 ERROR [m] a.B - new\n  more\n2024-01-15 14:30:24,123 INFO [m] a.B - info\n")
    run()
    assert [r.message for r in got] == ["new\n  more"]
    f.open("a").write("2024-01-15 14:31:23,123 ERROR [m] a.B - while down\n")
    run()
    run()
    assert [r.message for r in got] == ["new\n  more", "while down"]


def test_untimed_entries_get_the_time_of_the_batch(spark):
    lines = spark.createDataFrame([("a", 1, "no time here")], "source_file string, line_number long, line string")
    plain = next(p for p in builtin_profiles() if p.id == "plain-text")
    assert follow.parse_batch(lines, plain, NOW).select("timestamp").first()[0] == NOW.replace(tzinfo=None)


def test_new_files_are_parsed_as_they_appear(spark, tmp_path):
    """UTF-8 with and without mark, UTF-16, invalid bytes, by the format that is found; a file is read once, also by a query that is started again."""
    root, got = tmp_path / "logs", []
    (root / "__pycache__").mkdir(parents=True)
    line = "2024-01-15 14:30:%02d,123 ERROR [m] a.B - %s\n  more\n"
    (root / "a.log").write_bytes(b"".join((line % (i, f"é {i}")).encode() for i in range(30)))
    (root / "a.bin").write_text("no\n")
    (root / "__pycache__" / "b.log").write_text("no\n")
    files = lambda: follow.watch_new_files(spark, str(root))

    def run():
        sink = lambda e, i: got.extend((r.source_file.rsplit("/", 1)[1], r.line_number, r.message, r.profile_id, r.timestamp) for r in e.collect())
        q = follow.follow_new_files(files(), builtin_profiles(), sink, str(tmp_path / "c"), lambda: NOW, trigger={"availableNow": True})
        q.awaitTermination()

    run()
    assert sorted(got, key=str) == sorted((("a.log", 2 * i + 1, f"é {i}\n  more", "log4j-default", datetime(2024, 1, 15, 14, 30, i)) for i in range(30)), key=str)
    got.clear()
    (root / "w.log").write_bytes("".join(line % (i, "wide") for i in range(25)).encode("utf-16"))
    (root / "m.txt").write_bytes(b"\xef\xbb\xbffirst \xff\nsecond\n")
    run()
    assert Counter((f, p) for f, _, _, p, _ in got) == {("w.log", "log4j-default"): 25, ("m.txt", "plain-text"): 2}
    assert {m for f, _, m, _, t in got if f == "m.txt" and t == NOW.replace(tzinfo=None)} == {"first �", "second"}
    got.clear()
    run()
    assert got == []


def test_a_batch_of_new_files_is_two_jobs(spark, tmp_path):
    """One for its names, one for what is done with its lines, however many files; a job costs more than small files do."""
    for i in range(40):
        (tmp_path / f"a {i}.log").write_text("2024-01-15 14:30:22,123 ERROR [m] a.B - x\n" * 5)
    batch = list_files(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("new-files", "")
    try:
        lines = follow.lines_of_files(batch)
        lines.select("source_file", "line_number", "line").write.parquet(str(tmp_path / "out"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("new-files")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3  # the local table of names may be one
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == 200 and {r.source_file for r in read.select("source_file").distinct().collect()} == {f"file:{tmp_path}/a {i}.log" for i in range(40)}
    assert follow.lines_of_files(batch.where("false")) is None


def test_a_format_is_found_whatever_the_name(spark, tmp_path):
    root, got = tmp_path / "logs", []
    root.mkdir()
    (root / "a b%20.log").write_text("2024-01-15 14:30:22,123 ERROR [m] a.B - x\n" * 25)
    sink = lambda e, i: got.extend(r.profile_id for r in e.collect())
    follow.follow_new_files(follow.watch_new_files(spark, str(root)), builtin_profiles(), sink, str(tmp_path / "c"), lambda: NOW, trigger={"availableNow": True}).awaitTermination()
    assert got == ["log4j-default"] * 25


def test_new_files_by_time_and_pattern(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    for name, t in (("a.log", 1_000_000_000), ("b.log", 2_000_000_000), ("c.txt", 2_000_000_000), ("tmp-d.log", 2_000_000_000)):
        (root / name).write_text("x\n")
        os.utime(root / name, (t, t))
    seen = []
    files = follow.watch_new_files(spark, str(root), include=["*.log"], exclude=["tmp*"], modified_since=datetime(2020, 1, 1, tzinfo=timezone.utc), most=1)
    files.writeStream.foreachBatch(lambda b, i: seen.extend(r.path.rsplit("/", 1)[1] for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == ["b.log"]


def test_mtimes_in_rounds(tmp_path):
    """450 files, three rounds to see all; only changed ones come, each change once, also by a reader that takes over."""
    paths = [tmp_path / f"{i:03}.log" for i in range(450)]
    for p in paths:
        p.write_text("x")
        os.utime(p, (1_000_000_000, 1_000_000_000))
    new = lambda: mtimes.MtimeReader({"paths": json.dumps([str(p) for p in paths]), "positions": str(tmp_path / "m")})
    r, at = new(), {"round": 0}

    def rounds(n):
        nonlocal at
        got = []
        for _ in range(n):
            b = r.latestOffset()
            got += [(row[0][-7:-4], row[1].timestamp()) for part in r.partitions(at, b) for row in r.read(part)]
            at = b
        return got

    assert rounds(3) == [] and r.cursor == 0
    for i, t in ((5, 2_000_000_000.25), (210, 2_000_000_001), (449, 2_000_000_002)):
        os.utime(paths[i], (t, t))
    paths[6].unlink()
    assert rounds(1) == [("005", 2_000_000_000.25)] and r.cursor == 200
    planned = r.latestOffset()
    r = new()  # stopped before the round ran
    assert [row[0][-7:-4] for part in r.partitions(at, planned) for row in r.read(part)] == ["210"] and r.cursor == 400
    at = planned
    assert rounds(1) == [("449", 2_000_000_002)] and rounds(6) == []
    os.utime(paths[5], (3_000_000_000, 3_000_000_000))
    assert rounds(3) == [("005", 3_000_000_000)]


def test_mtimes_as_a_stream(spark, tmp_path):
    f = tmp_path / "a.log"
    f.write_text("x")
    got = []
    q = mtimes.mtime_source(spark, [str(f)], str(tmp_path / "m")).writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        os.utime(f, (2_000_000_000, 2_000_000_000))
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.path, r.modified) for r in got] == [(str(f), datetime(2033, 5, 18, 3, 33, 20))]


def test_rolling_window(spark, tmp_path):
    """Batch by batch, in append mode: what is final is exact at every second, and expired seconds leave the state."""
    from datetime import timedelta

    t0, got = datetime(2024, 1, 1, tzinfo=timezone.utc), []
    folder = tmp_path / "in"
    schema = "timestamp timestamp, severity string"
    times = [0, 0.4, 1, 1.5, 7, 7.999, 30, 31.25, 200, 201]
    for k, part in enumerate((times[:5], times[5:8], times[8:])):
        spark.createDataFrame([(t0 + timedelta(seconds=t), "Error" if i % 2 else "Info") for i, t in enumerate(part)], schema).coalesce(1).write.parquet(str(folder / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = follow.rolling_changes(stream, 5, "2 seconds").writeStream.outputMode("append").foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    for c in range(0, 60):
        now = t0.replace(tzinfo=None) + timedelta(seconds=c)
        assert sum(r.change for r in got if r.at <= now) == sum(c - 5 <= t <= c for t in times)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    changes = spark.createDataFrame(got, "at timestamp, severity string, change long")
    counted = follow.rolling_counts(changes, [t0 + timedelta(seconds=s) for s in (1, 5, 10)])
    assert sorted(((r.clock.second, r.n) for r in counted.groupBy("clock").agg(F.sum("n").alias("n")).collect())) == [(1, 3), (5, 4), (10, 2)]

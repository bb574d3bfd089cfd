"""Stored tables that grow batch by batch, and pages of a stored timeline, against plain Python."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logweir.operators import analyse, pages, textindex
from logweir.operators.filters import FilterSpec, apply_filters
from logweir.streaming import live

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "timestamp timestamp, severity string, severity_rank tinyint, source_file string, line_number long, thread string, component string, message string, raw_text string, profile_id string, file_modified timestamp"


def batch(spark, rng, k, n):
    rows = [(T0 + timedelta(seconds=k * 100 + rng.randrange(-400, 100)) if rng.random() < 0.9 else None, rng.choice(["Error", "Info"]), 1, f"f{rng.randrange(3)}", k * 1000 + i, None, None, f"m{rng.randrange(50)}", "r", "p", None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_ring(spark, tmp_path):
    """Several batches, one given again, one empty; whole segments go, ids go on."""
    rng, ring, seen = random.Random(1), live.RingTable(spark, str(tmp_path / "ring"), most=100, first_id=1000), []
    for k, n in enumerate((40, 0, 70, 10, 300, 5, 20)):
        b = batch(spark, rng, k, n)
        for _ in range(2 if k in (0, 3, 4) else 1):
            ring.append(b, k)
        schema = spark.createDataFrame([], SCHEMA + ", id long").schema
        seen += [r.line_number for r in b.orderBy("source_file", "line_number").collect()]
        got = sorted((r.id, r.line_number) for r in ring.read(schema).collect())
        assert got == list(enumerate(seen, 1000))[-100:]
    assert len(ring.segments.all()) < 5 and ring.segments.clean() >= 0
    assert sorted(r.id for r in live.RingTable(spark, str(tmp_path / "ring"), most=100, first_id=1000).read(schema).collect()) == [i for i, _ in got]


def test_a_stopped_writer_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    """Data without a manifest isn't read, and the batch is written when it is given again."""
    ring, rng = live.RingTable(spark, str(tmp_path / "ring")), random.Random(2)
    b = batch(spark, rng, 0, 10)
    whole = live.asdict
    monkeypatch.setattr(live, "asdict", lambda _: {}["stopped"])
    with pytest.raises(KeyError):
        ring.append(b, 0)
    monkeypatch.setattr(live, "asdict", whole)
    schema = spark.createDataFrame([], SCHEMA + ", id long").schema
    for name in os.listdir(tmp_path / "ring" / "manifests"):
        assert name.endswith(".json")
    assert ring.read(schema).count() == 0
    ring.append(b, 0)
    assert sorted(r.id for r in ring.read(schema).collect()) == list(range(10)) and ring.segments.clean() == 1 and ring.read(schema).count() == 10


def test_view_equals_the_filtered_timeline(spark, tmp_path):
    """After each batch, late rows, a batch given again, merges in between; also a stretch of it and a window that moves with the clock."""
    rng, spec = random.Random(3), FilterSpec(severities=frozenset({"Error"}), text="m")
    view, moving = live.LiveView(spark, str(tmp_path / "v"), spec, fan_in=2), live.LiveView(spark, str(tmp_path / "w"), FilterSpec(last_seconds=250))
    every, schema, merges = None, None, 0
    for k in range(7):
        b = batch(spark, rng, k, rng.choice([5, 30])).withColumn("id", F.col("line_number"))
        schema = b.schema
        for _ in range(1 + (k == 2)):
            view.append(b, k), moving.append(b, k)
        every = b if every is None else every.unionByName(b)
        if k % 2:
            while view.merge(schema):
                merges += 1
        want = [r.id for r in analyse.timeline(apply_filters(every, spec)).collect()]
        assert [r.id for r in analyse.timeline(view.read(schema)).collect()] == want
    assert merges > 1 and len(view.segments.all()) < 7
    a, z = T0 + timedelta(seconds=100), T0 + timedelta(seconds=300)
    part = apply_filters(every, spec).where(F.col("timestamp").between(F.lit(a), F.lit(z)))
    assert sorted(r.id for r in view.read(schema, start=a, end=z).collect()) == sorted(r.id for r in part.collect())
    now = T0 + timedelta(seconds=600)
    assert sorted(r.id for r in moving.read(schema, as_of=now).collect()) == sorted(r.id for r in apply_filters(every, FilterSpec(last_seconds=250), now).collect())
    with pytest.raises(ValueError):
        live.LiveView(spark, "x", FilterSpec(bookmarked=True))


def test_pages(spark, tmp_path):
    rng = random.Random(4)
    rows = [(T0 + timedelta(seconds=rng.randrange(50)) if rng.random() < 0.7 else None, i, "x" * 10) for i in range(1000)]
    entries = spark.createDataFrame(rows, "timestamp timestamp, id long, message string")
    path = str(tmp_path / "t")
    pages.store_timeline(entries, path, file_rows=90)
    order = [r.id for r in analyse.timeline(entries).collect()]
    assert pages.timeline_rows(spark, path) == 1000
    for at, n in ((0, 10), (85, 30), (990, 50), (999, 1), (1000, 5), (300, 250), (0, 2000)):
        got = pages.page(spark, path, at, n)
        assert [r.id for r in got.collect()] == order[at : at + n]
        assert [r.id for r in pages.page(spark, path, at, n, newest_first=True).collect()] == order[::-1][at : at + n]
    assert len(pages.page(spark, path, 500, 20).inputFiles()) <= 2
    pages.store_timeline(entries.limit(0), str(tmp_path / "e"))
    assert pages.timeline_rows(spark, str(tmp_path / "e")) == 0 and pages.page(spark, str(tmp_path / "e"), 0, 5).count() == 0


def test_search_of_a_stored_table(spark, tmp_path):
    """Equal to the filter over all rows; a rare text opens few files; short and absent texts, nulls, other letters."""
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÄRGER", "日本語", "x", "né", None]
    rows = [(T0 + timedelta(seconds=i), i, "Error", " ".join(w for w in rng.choices(words, k=4) if w) + (" needle %d" % i if i == 777 else ""), rng.choice(words), rng.choice(words), None) for i in range(1000)]
    entries = spark.createDataFrame(rows, "timestamp timestamp, id long, severity string, message string, thread string, component string, file_modified timestamp")
    path = str(tmp_path / "s")
    textindex.store_searchable(entries, path, file_rows=100)
    for text in ("NEEDLE 777", "alpha beta", "ärger", "日本語", "本", "x", "nothing of it", "né né"):
        spec = FilterSpec(text=text, severities=frozenset({"Error"}))
        got, want = textindex.search_stored(spark, path, spec), apply_filters(entries, spec)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), text
    assert len(textindex.files_with(spark, path, "needle")) == 1 and textindex.files_with(spark, path, "nothing of it") == [] and textindex.files_with(spark, path, "né") is None
    assert len(textindex.search_stored(spark, path, FilterSpec(text="needle")).inputFiles()) == 1
    fuzzy = FilterSpec(text="alpet", fuzzy=True)
    assert textindex.search_stored(spark, path, fuzzy).count() == apply_filters(entries, fuzzy).count()

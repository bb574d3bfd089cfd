import gzip
import json
import random
import re
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from logweir.functions.text import NORMALISED, fuzzy, glob_regex, severity_rank
from logweir.operators import analyse, correlate, detect, filters, search, sinks
from logweir.plans import registry
from logweir.sources import files as source_files
from logweir.sources.event_xml import read_event_xml
from logweir.sources.files import list_files, mark_chosen, newest, not_loaded, read_files, read_lines, read_utf16_lines, search_files
from logweir.sources.profiles import builtin_profiles

T = datetime(2024, 1, 15, 14, 30, tzinfo=timezone.utc)
SCHEMA = "id long, timestamp timestamp, severity string, source_file string, line_number long, thread string, component string, message string, raw_text string, profile_id string, file_modified timestamp"


def entries(spark, *rows):
    full = [(i + 1, r.get("t"), r.get("s", "Info"), r.get("f", "a.log"), i + 1, r.get("th"), r.get("c"), r.get("m", ""), r.get("m", ""), "p", r.get("fm")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("severity_rank", severity_rank(F.col("severity")))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(spark):
    e = entries(spark, {"m": "Connection error", "s": "Error", "t": T}, {"m": "fine", "th": "worker", "fm": T}, {"m": "fine", "c": "Disk", "s": "Critical"})
    run = lambda **k: ids(filters.apply_filters(e, filters.FilterSpec(**k), T))
    assert run() == [1, 2, 3] and run(text="CERR", fuzzy=True) == [1] and run(text="WORK") == [2] and run(regex="^disk$") == [3]
    assert run(exclude="disk") == [1, 2] and run(components=frozenset({"Disk"})) == [3] and run(start=T - timedelta(1)) == [1, 2] and run(hide_untimed=True) == [1]
    assert run(last_seconds=60) == [1, 2] and run(at_least="Error") == [1, 3] and run(hide_all_sources=True) == []
    assert filters.FilterSpec(text="x").describe() == "text: x" and filters.parse_moment("2024-01-15 15:30", "Europe/Berlin") == T
    with pytest.raises(Exception):
        filters.FilterSpec(regex="(").to_column()


def test_multi_search(spark):
    e = entries(spark, {"m": "an error occurred"}, {"m": "errorhandler myerror"}, {"m": "found error[0] in log"}, {"m": "error[0]0", "c": "db"})
    run = lambda text, **k: ids(e.where(search.MultiSearch.parse(text, **k).to_column()))
    assert run("error", whole_word=True) == [1, 3, 4] and run("error[0]", whole_word=True) == [3] and run("error, found, log", min_match=10) == [3]
    assert run("error, occurred, x", min_match=2) == [1] and run("error, occurred, x", min_match=0) == [1, 2, 3, 4] and run("-db") == [1, 2, 3] and run("db") == [4]
    assert search.MultiSearch.parse("(", regex=True).problems()[0][0] == 0 and search.MultiSearch.parse("a++, \\p{IsLatin}", regex=True).problems(spark) == []
    assert search.MultiSearch.parse("--x, -!y, - z, !").excluded == ("-x", "!y", "z")
    h = lambda text, q: [tuple(r) for r in spark.range(1).select(search.highlight(F.lit(text), search.MultiSearch.parse(q))).first()[0]]
    assert h("database error occurred", "database error, error") == [(0, 14)] and h("é ab ab", "ab") == [(3, 5), (6, 8)] and h("aabb", "aa, bb") == [(0, 4)]


def test_dedup_and_timeline(spark):
    e = entries(spark, *[{"m": f"Failed to connect to 10.0.0.{i}:80", "t": T + timedelta(minutes=5 * i)} for i in range(3)], {"m": "OK"}, {"m": "OK"})
    assert ids(analyse.dedup(e)) == [1, 2, 3, 5]
    n = {r.id: r for r in analyse.dedup(e, normalized=True).collect()}
    assert sorted(n) == [3, 5] and n[3]["count"] == 3 and n[3].first_timestamp == T.replace(tzinfo=None) and [o.id for o in n[3].occurrences] == [1, 2, 3]
    assert analyse.expand_occurrences(analyse.dedup(e, True)).count() == 5
    order = [r.id for r in analyse.timeline(e).collect()]
    assert order == [1, 2, 3, 4, 5] and [r.id for r in analyse.timeline(e, True).collect()] == order[::-1]
    assert [r.id for r in analyse.timeline(e, after=(T + timedelta(minutes=5), 2), limit=2).collect()] == [3, 4]
    assert analyse.counts(e, F.col("id") < 3).first().asDict() == {"total": 5, "matched": 2, "hidden": 3, "untimed": 2}


def test_survivors_and_occurrences_without_arrays(spark, monkeypatch):
    """What ``dedup`` says, without an array of a group's rows, for hot and other keys and null ones."""
    monkeypatch.setattr(analyse, "HOT_ROWS", 3)
    rows = [{"m": m, "f": f, "t": T + timedelta(minutes=i) if i % 3 else None} for i, (m, f) in enumerate([("hot 1", "a.log")] * 9 + [("hot 2", "b.log"), ("x", None), ("x", None), (None, "a.log"), (None, "a.log"), ("", "a.log")])]
    e = entries(spark, *rows)
    for normalized in (False, True):
        want = {r.id: r for r in analyse.dedup(e, normalized).collect()}
        got = analyse.survivors(e, normalized, {"ids": "id"})
        assert "collect_list" not in got._jdf.queryExecution().toString()
        got = {r.id: r for r in got.collect()}
        assert {(i, r["count"], r.first_timestamp, r.message, r.ids) for i, r in got.items()} == {(i, r["count"], r.first_timestamp, r.message, sum(o.id for o in r.occurrences)) for i, r in want.items()}
        long = sorted((r.survivor_id, r.id, r.line_number) for r in analyse.occurrences(e, normalized).collect())
        assert long == sorted((i, o.id, o.line_number) for i, r in want.items() for o in r.occurrences)
    if (sf := Path("/root/testdata/sf0.001")).is_dir():
        for name in ("dedup_exact", "dedup_normalized"):
            assert "collect_list" not in registry.queries()[name](spark, str(sf))._jdf.queryExecution().toString()


def test_normalize_all_lines_matches_brute_force(spark, tmp_path):
    """No line is left out, and boundaries and digits are Unicode's, as Python's are."""
    rng = random.Random(3)
    lines = ["é12 12é 12", "٣ items", "zähler=17", "中1 1", "", "größe 0xDEADBEEF", "1.2.3.4:80é", "::1 ü"] + ["".join(rng.choice("aféx中01٣.:- ") for _ in range(rng.randrange(25))) for _ in range(300)]
    spark.createDataFrame([(0, "\n".join(lines), "s"), (1, None, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want: dict = {}
    for key in lines:
        for pattern, mark in NORMALISED:
            key = re.sub(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", pattern), mark, key)
        want[key] = want.get(key, 0) + 1
    got = {r.key: r.n for r in registry.queries()["normalize_all_lines"](spark, str(tmp_path)).collect()}
    assert got == want and got["<NUM> items"] >= 1 and "é12 12é <NUM>" in got


def test_correlate(spark):
    e = entries(spark, *[{"t": T + timedelta(seconds=s)} for s in (-31, -30, 0, 30, 31)], {})
    assert ids(correlate.correlate(e, T)) == [2, 3, 4] and ids(correlate.correlate(e, None)) == []
    assert sorted(r.id for r in correlate.correlate_many(e, e.where("id = 3")).collect()) == [2, 3, 4]


def test_detection(spark):
    ps = builtin_profiles()
    lines = spark.createDataFrame([("/x/app.log", i, "2024-01-15 14:30:22,123 ERROR [m] a - b") for i in range(1, 5)] + [("/x/u_ex1.log", 1, "2024-01-15 14:30:22 x"), ("/x/other", 1, "text")], "source_file string, line_number long, line string")
    files = spark.createDataFrame([("/x/app.log",), ("/x/u_ex1.log",), ("/x/other",), ("/x/access.log",)], "path string")
    got = {r.path: (r.profile_id, r.detection_confidence) for r in detect.detect_formats(lines, files, ps).collect()}
    assert got == {"/x/app.log": ("log4j-default", 1.0), "/x/u_ex1.log": ("iis-w3c", 1.0), "/x/other": ("plain-text", 0.0), "/x/access.log": ("apache-combined", 0.3)}


def test_infer(spark):
    lines = spark.createDataFrame([(f"/x/svc{n}.log", i, f"2024-01-15 14:30:2{i} ERROR start of {i}", T) for n in (1, 2) for i in range(1, 6)], "source_file string, line_number long, line string, file_modified timestamp")
    r = detect.infer_profile(lines).first()
    assert (r.glob, r.timestamp_format, r.levels, r.anchor) == ("svc*.log", "%Y-%m-%d %H:%M:%S", ["Error"], "N-N-N N:N:N ERROR")
    assert detect.proposed(r, "mine").group("timestamp") == 1


def test_files(spark, tmp_path):
    for name, text in (("a.log", "x\r\ny\n"), ("b.zip", "z"), (".git/c.log", "z"), ("d/e/f.log.1", "one\n\ntwo"), ("u.txt", "u")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    (tmp_path / "w.txt").write_bytes("é\r\nü".encode("utf-16"))
    files = list_files(spark, str(tmp_path))
    assert sorted(r.name for r in files.collect()) == ["a.log", "f.log.1", "u.txt", "w.txt"]
    assert sorted(r.name for r in list_files(spark, str(tmp_path), max_depth=1).collect()) == ["a.log", "u.txt", "w.txt"]
    cut, total = newest(files, 2)
    assert (cut.count(), total) == (2, 4) and not_loaded(files, cut).count() == 2
    assert {r.name for r in files.where(search_files("a.l, *.TXT")).collect()} == {"a.log", "u.txt", "w.txt"}
    assert mark_chosen(files, files.where("name = 'a.log'")).where("parsing_skipped").count() == 3
    assert [(r.line_number, r.line) for r in read_lines(spark, str(tmp_path / "a.log")).orderBy("line_number").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "bom.txt").write_bytes("\ufeffone\r\ntwo\n".encode())
    every = {(r.source_file.rsplit("/", 1)[1], r.line_number, r.line) for r in read_lines(spark, [str(tmp_path / n) for n in ("a.log", "w.txt", "bom.txt")]).collect()}
    assert every == {("a.log", 1, "x"), ("a.log", 2, "y"), ("w.txt", 1, "é"), ("w.txt", 2, "ü"), ("bom.txt", 1, "one"), ("bom.txt", 2, "two")}
    assert [(r.line_number, r.line) for r in read_utf16_lines(spark, str(tmp_path / "w.txt")).collect()] == [(1, "é"), (2, "ü")]


@pytest.mark.parametrize("whole", [None, 20])
def test_files_named_by_a_table(spark, tmp_path, monkeypatch, whole):
    """Read whole or in splits, the lines are those of the splitting reader; names stand for themselves, whatever is in them."""
    if whole:
        monkeypatch.setattr(source_files, "WHOLE_BYTES", whole)
    content = {
        "a.log": b"one\r\ntwo\n\nthree", "cr.log": b"x\r\r\n\r\n", "mark.log": b"\xef\xbb\xbffirst\n\xef\xbb\xbfsecond\n", "only_mark.log": b"\xef\xbb\xbf", "break.log": b"\n",
        "bad.log": b"a \xe2\x28\xa1 \xf0\x9f\x98\n\xed\xa0\x80 \xc0\xaf\n \xff\xfe", "w.log": "w\u00e4\r\nide\n\n".encode("utf-16"), "g.log.gz": gzip.compress(b"packed\nlines of text\n" * 3),
    }
    for name, text in content.items():
        (tmp_path / name).write_bytes(text)
    rows = lambda lines: sorted((r.source_file, r.line_number, r.line, r.file_modified) for r in lines.collect())
    every = list_files(spark, str(tmp_path), include=[], exclude=[])
    assert rows(read_files(every)) == rows(read_lines(spark, str(tmp_path))) != []
    odd = tmp_path / "b c"
    odd.mkdir()
    for name in ("q[1].log", "y %20+z.log", "ü.log"):
        (odd / name).write_text(f"in {name}\nand more of it\n")
    got = {(r.source_file.removeprefix("file:"), r.line) for r in read_files(list_files(spark, str(odd))).where("line_number = 1").collect()}
    assert got == {(f"{odd}/{name}", f"in {name}") for name in ("q[1].log", "y %20+z.log", "ü.log")}


def test_names_of_files_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    """The query that reads listed files builds its plan and its rows without a list of them."""
    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(collect(self)) or collected[-1])
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("text of "), F.col("id").cast("string"), F.lit("\nmore")).alias("text"))
    d.withColumn("doc_id", F.col("doc_id") * 100).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["read_listed"](spark, str(tmp_path))
    assert sum(map(len, collected)) == 0
    assert [(r.n, r.longest) for r in got.select("n", "longest").distinct().orderBy("longest").collect()] == [(2, 9), (2, 10), (2, 11)] and got.count() == 300


def test_line_numbers_over_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(f"file {k} line {i + 1}\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 600 and all(r.line.endswith(f"line {r.line_number}") for r in rows)


def test_event_xml(spark):
    xml = "<Event><System><Provider Name='P'/><EventID>7</EventID><Level>2</Level><TimeCreated SystemTime='2024-01-15T14:30:22.1234567Z'/><EventRecordID>9</EventRecordID><Execution ProcessID='4' ThreadID='5'/><Channel>C</Channel><Computer>H</Computer></System><EventData>" + "".join(f"<Data Name='k{i}'>v&amp;{i}</Data>" for i in range(25)) + "</EventData></Event>"
    r = read_event_xml(spark.createDataFrame([("f", xml), ("f", "<broken")], "source_file string, xml string")).orderBy(F.desc_nulls_last("line_number")).first()
    assert (r.severity, r.component, r.thread, r.line_number, str(r.timestamp)) == ("Error", "P", "4", 9, "2024-01-15 14:30:22.123456")
    assert r.message.startswith("EventID 7 | P | C | H | k0=v&0, k1=v&1") and "k19" in r.message and "k20" not in r.message


def test_sinks(spark, tmp_path):
    e = entries(spark, {"m": 'say "hi"\nthere', "t": T, "s": "Error"}, {"m": "b"})
    sinks.export_csv(e, str(tmp_path / "csv"), T, "none")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv") + "/part-*")
    assert sorted((r.message, r.timestamp) for r in back.collect()) == [("b", None), ('say "hi"\nthere', "2024-01-15T14:30:00+00:00")]
    sinks.export_json(e, str(tmp_path / "json"), T)
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json") + "/part-*").collect()]
    assert len(rows) == 2 and "file_modified" not in rows[0]
    sinks.write_tables(e, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    text = [r.value for r in sinks.report(e, most=1).collect()]
    assert text[1].startswith("[2024-01-15 14:30:00 UTC] ERROR     a.log") and "1 more" in text[2]
    marks = spark.createDataFrame([(2, "look")], "id long, label string")
    assert "[look]" in sinks.bookmark_report(e, marks).first().value and sinks.selected_text(e, marks).first().value == "b"


def test_globs_and_fuzzy(spark):
    import re

    hit = lambda g, s: bool(re.match(glob_regex(g).replace(r"\z", r"\Z"), s))
    assert hit("*.log", "a/b.log") and hit("a?.[0-9]*", "ab.7x") and not hit("*.log", "a.logx") and hit("[!a]b", "cb")
    assert [spark.range(1).select(fuzzy(F.lit(t), q)).first()[0] for t, q in (("FAILED", "fail"), ("abc", "xyz"))] == [True, False]


def test_many_terms_in_one_scan(spark):
    """As the terms one by one: terms within others, letters that fold to ASCII, whole words, nulls."""
    import random

    from logweir.operators.search import MultiSearch

    rng = random.Random(1)
    parts = ["a", "b", "A", "ß", "k", "K", "ſ", "s", "-", "_", " ", "1", ".", "é", "ab", "i", "ı", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(18))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for terms in (("a", "ab", "abk", "s", "b-a"), ("k", "is", "1", "a_b", "_", "a.", "bab"), ("aa", "a", "aaa", "-", "--")):
        for whole in (False, True):
            for fold in (True, False):
                s = MultiSearch(terms, ignore_case=fold, whole_word=whole)
                assert s.one_scan()
                one_by_one = F.array_compact(F.array(*[F.when(F.col("t").rlike(s.pattern(t)), i) for i, t in enumerate(terms)]))
                wrong = df.where(F.col("t").isNotNull() & (F.array_sort(s.terms_in(F.col("t"))) != F.array_sort(one_by_one)))
                assert wrong.collect() == [], (terms, whole, fold)
    many = MultiSearch(terms, min_match=2)
    assert df.where(many.to_column(F.col("t"))).count() == df.where(sum([F.coalesce(F.col("t").rlike(many.pattern(t)), F.lit(False)).cast("int") for t in terms[1:]], F.coalesce(F.col("t").rlike(many.pattern(terms[0])), F.lit(False)).cast("int")) >= 2).count()
    assert not MultiSearch(("é", "b", "c", "d")).one_scan() and not MultiSearch(("a", "b", "c", "d"), regex=True).one_scan()
    with pytest.raises(ValueError, match="more than 200"):
        MultiSearch(tuple(f"t{i}" for i in range(201))).to_column(F.col("t"))


def test_correlate_any(spark):
    import random
    from datetime import datetime, timedelta, timezone

    from logweir.operators.correlate import correlate_any, correlate_many

    rng, t0 = random.Random(2), datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = lambda: t0 + timedelta(seconds=rng.randrange(-2000, 2000), microseconds=rng.choice([0, 0, 1, 999_999])) if rng.random() < 0.95 else None
    entries = spark.createDataFrame([(i, at(), "x") for i in range(800)], "id long, timestamp timestamp, at string")
    anchors = spark.createDataFrame([(i, at()) for i in range(25)] + [(99, t0)] * 3, "id long, timestamp timestamp")
    for w in (1, 30, 3600):
        got = [r.id for r in correlate_any(entries, anchors, w).collect()]
        want = {r.id for r in correlate_many(entries, anchors, w).select("id").collect()}
        assert len(got) == len(want) and set(got) == want
    assert correlate_any(entries, anchors.limit(0)).count() == 0 and correlate_any(entries, anchors).columns == entries.columns

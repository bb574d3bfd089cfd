from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logweir.functions.text import normalize_message, preview, truncate_bytes
from logweir.functions.timestamps import has_offset, parse_timestamp, sniff_timestamp, spark_format
from logweir.operators import parse
from logweir.sources.profiles import Profile, builtin_profiles, java_regex, load_profiles, problems, register_profile

AS_OF = datetime(2024, 6, 1, tzinfo=timezone.utc)
BY_ID = {p.id: p for p in builtin_profiles()}


def lines(spark, *texts, file="/logs/a.log"):
    return spark.createDataFrame([(file, i + 1, t) for i, t in enumerate(texts)], "source_file string, line_number long, line string")


CASES = [
    ("apache-combined", '203.0.113.7 - olga [08/Jul/2031:09:10:11 +0100] "PUT /basket/4 HTTP/2.0" 201 77 "-" "probe/9"', "Unknown", "2031-07-08 09:10:11", None, "203.0.113.7"),
    ("apache-combined", '198.51.100.2 - - [08/Jul/2031:09:10:11 +0000] "GET /x HTTP/1.0" 503 5 "-" "-"', "Error", "2031-07-08 09:10:11", None, "198.51.100.2"),
    ("exchange-tracking", "2031-07-08T09:10:11.500Z,,,,STOREDRIVER,,,Local,DELIVER,<m1>,q", "Info", "2031-07-08 09:10:11", None, None),
    ("iis-w3c", "2031-07-08 09:10:11 198.51.100.4 GET /status - 80 - 203.0.113.9 probe - 502 1 2 30", "Error", "2031-07-08 09:10:11", None, None),
    ("intune-ime", '<![LOG[agent woke up]LOG]!><time="09:10:11.500+000" date="7-8-2031" component="Agent" context="" type="3" thread="4" file="a.cpp">', "Error", "2031-07-08 00:00:00", "4", "Agent"),
    ("json-lines", '{"timestamp":"2031-07-08T09:10:11Z","level":"warn","message":"disk almost full","service":"store"}', "Warning", "2031-07-08 09:10:11", None, None),
    ("kubernetes-klog", "W0708 09:10:11.000250       7 probe.go:12] slow answer", "Warning", "2024-06-01 09:10:11.000250", None, None),
    ("log4j-default", "2031-07-08 09:10:11,012 WARN [pool-7] shop.Cart - basket is empty", "Warning", "2031-07-08 09:10:11", "pool-7", "shop.Cart"),
    ("nginx-error", "2031/07/08 09:10:11 [crit] 77#8: *9 no space left", "Critical", "2031-07-08 09:10:11", "77#8", None),
    ("postgresql-log", "2031-07-08 09:10:11.250 UTC [88] FATAL:  too many clients", "Error", "2031-07-08 09:10:11.250000", "88", None),
    ("sql-server-agent", "2031-07-08 09:10:11 - ! [21] job seven stopped", "Error", "2031-07-08 09:10:11", "21", None),
    ("sql-server-error", "2031-07-08 09:10:11.40 spid9       Starting up database nine.", "Info", "2031-07-08 09:10:11", None, "spid9"),
    ("syslog-rfc3164", "Jul  8 09:10:11 host7 sshd[99]: session opened", "Unknown", "2024-07-08 09:10:11", "99", "host7"),
    ("syslog-rfc5424", "<11>1 2031-07-08T09:10:11.250Z host7 app 66 ID1 - low battery", "Unknown", "2031-07-08 09:10:11.250000", "66", "host7"),
    ("tomcat-catalina", "08-Jul-2031 09:10:11.250 WARNING [exec-3] shop.Cart.pay slow answer", "Warning", "2031-07-08 09:10:11.250000", "exec-3", "shop.Cart.pay"),
    ("windows-cluster", "00000b10.00000c20::2031/07/08-09:10:11.001 WARN  [NM] node two is late", "Warning", "2031-07-08 09:10:11", "00000b10.00000c20", None),
    ("windows-dhcp", "10,07/08/31,09:10:11,Assign,198.51.100.8,BOX,0A0B0C", "Info", "2031-07-08 09:10:11", "10", None),
    ("windows-firewall", "2031-07-08 09:10:11 ALLOW UDP 198.51.100.8 203.0.113.1 53 53 0 - - - - - - - SEND", "Info", "2031-07-08 09:10:11", None, None),
    ("generic-timestamp", "2031/07/08 09:10:11 shift ended", "Unknown", "2031-07-08 09:10:11", None, None),
    ("plain-text", "an Unhandled case of [INFO]", "Error", None, None, None),
    ("veeam-vbr", "[08.07.2031 09:10:11.250]    <21>    Warning (3)            [QQ] slow target", "Warning", "2031-07-08 09:10:11", "21", None),
    ("veeam-vbo365", "7/8/2031 9:10:11 AM 5 (77) Warning: slow mailbox", "Warning", "2031-07-08 09:10:11", "77", "5"),
]


@pytest.mark.parametrize("profile,line,severity,stamp,thread,component", CASES)
def test_profiles(spark, profile, line, severity, stamp, thread, component):
    r = parse.parse_lines(lines(spark, line), BY_ID[profile], AS_OF).first()
    assert (r.severity, r.thread, r.component) == (severity, thread, component)
    assert (str(r.timestamp) if r.timestamp else None) == stamp


def test_continuation_and_errors(spark):
    p = BY_ID["log4j-default"]
    got = lines(spark, "orphan", "", "2024-01-15 14:30:22,123 ERROR [main] a.B - first", "  at x", "", "  at y", "2024-01-15 14:30:23,000 INFO [t] a.B - second")
    rows = sorted(parse.parse_lines(got, p, AS_OF).collect(), key=lambda r: r.line_number)
    assert [(r.line_number, r.message, r.severity) for r in rows] == [(3, "first\n  at x\n  at y", "Error"), (7, "second", "Info")]
    assert [(r.line_number, r.reason) for r in parse.parse_errors(got, p, AS_OF).collect()] == [(1, "line")]


def test_heads_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(parse, "BLOCK_LINES", 2)
    p = BY_ID["log4j-default"]
    got = lines(spark, "2024-01-15 14:30:22,123 ERROR [main] a.B - m", *[f" l{i}" for i in range(6)])
    assert [r.message for r in parse.parse_lines(got, p, AS_OF).collect()] == ["m\n" + "\n".join(f" l{i}" for i in range(6))]
    many = lines(spark, *["x"] * 7).unionByName(lines(spark, *["y"] * 3, file="/logs/b/c.log"))
    ids = parse.assign_ids(parse.parse_lines(many, BY_ID["plain-text"], AS_OF), 5).orderBy("id").collect()
    assert [r.id for r in ids] == list(range(5, 15)) and [r.source_file for r in ids][:7] == ["/logs/a.log"] * 7
    assert parse.next_id(parse.assign_ids(parse.parse_lines(many, BY_ID["plain-text"], AS_OF)), 99) == 100


def test_long_entries(spark, monkeypatch):
    """Many blank lines inside an entry lose nothing; an entry over the limit is cut at it, also across blocks."""
    p = BY_ID["log4j-default"]
    head = ("/l", 1, "2031-07-08 09:10:11,012 WARN [w] q.R - first")
    rows = spark.createDataFrame([head, ("/l", 70_000, "behind blank lines"), ("/l", 70_001, "\t")], "source_file string, line_number long, line string")
    assert [r.message for r in parse.parse_lines(rows, p, AS_OF).collect()] == ["first\nbehind blank lines"]
    monkeypatch.setattr(parse, "BLOCK_LINES", 7)
    monkeypatch.setattr(parse, "MAX_ENTRY_BYTES", 100)
    for n, size in ((40, 9), (11, 9), (10, 9), (9, 9), (1, 200), (3, 31)):
        rows = [("/l", 1, "2031-07-08 09:10:11,012 WARN [w] q.R - m")] + [("/l", i + 2, str(i % 10) * size) for i in range(n)] + [("/l", n + 2, "2031-07-08 09:10:12,000 INFO [w] q.R - next")]
        got = {r.line_number: r for r in parse.parse_lines(spark.createDataFrame(rows, "source_file string, line_number long, line string"), p, AS_OF).collect()}
        full = "\n".join(["m"] + [r[2] for r in rows[1:-1]])
        raw = "\n".join(r[2] for r in rows[:-1])
        cut = lambda t: t if len(t) <= 100 else t[:100] + "... [truncated]"
        assert (got[1].message, got[1].raw_text, got[n + 2].message) == (cut(full), cut(raw), "next")


def test_ids_of_rows_without_line_or_file(spark):
    rows = [("/b", 2, "x"), ("/b", None, "z"), ("/b", None, "y"), (None, 1, "q"), (None, None, "r"), ("/a", 1, "p"), ("/b", None, "y")]
    got = parse.assign_ids(spark.createDataFrame(rows, "source_file string, line_number long, raw_text string"), 10).orderBy("id").collect()
    assert [(r.source_file, r.line_number, r.raw_text) for r in got] == [("/a", 1, "p"), ("/b", 2, "x"), ("/b", None, "y"), ("/b", None, "y"), ("/b", None, "z"), (None, 1, "q"), (None, None, "r")]
    assert [r.id for r in got] == list(range(10, 17))


def test_lines_with_the_separator(spark):
    got = lines(spark, "2031-07-08 09:10:11,012 WARN [w] q.R - a\ufdd1b", "2031-07-08 09:10:11,012 WARN [w] q.R - plain")
    assert sorted((r.message, r.severity, r.thread) for r in parse.parse_lines(got, BY_ID["log4j-default"], AS_OF).collect()) == [("a\ufdd1b", "Warning", "w"), ("plain", "Warning", "w")]


def test_skip_and_raw(spark):
    got = lines(spark, "#Fields: x", "2024-01-15 14:30:23 GET / 404 ", "junk")
    assert parse.parse_lines(got, BY_ID["iis-w3c"], AS_OF).count() == 1
    assert parse.parse_errors(got, BY_ID["iis-w3c"], AS_OF).count() == 2
    assert parse.parse_lines(got, BY_ID["plain-text"], AS_OF).count() == 3
    assert parse.parse_errors(got, BY_ID["plain-text"], AS_OF).count() == 0


def test_parse_all_falls_back(spark):
    a, b = lines(spark, "2024-01-15 14:30:22,123 ERROR [main] a.B - first"), lines(spark, "no such format", file="/logs/b.log")
    found = spark.createDataFrame([("/logs/a.log", "log4j-default"), ("/logs/b.log", "log4j-default")], "path string, profile_id string")
    c = lines(spark, "not detected", file="/logs/c.log")
    got = {r.source_file: r.profile_id for r in parse.parse_all(a.unionByName(b).unionByName(c), found, builtin_profiles(), AS_OF).collect()}
    assert got == {"/logs/a.log": "log4j-default", "/logs/b.log": "plain-text", "/logs/c.log": "plain-text"}


SNIFFED = [
    ("at 2024-01-15T14:30:22.5+05:30 x", "2024-01-15 09:00:22.500000"), ("2024-01-15T14:30:22+0530", "2024-01-15 09:00:22"), ("2024-01-15 14:30:22,123 x", "2024-01-15 14:30:22.123000"),
    ("x 2024-01-15T14:30:22", "2024-01-15 14:30:22"), ("2024/01/15 14:30:22.25", "2024-01-15 14:30:22.250000"), ("26.02.2026 22:07:56", "2026-02-26 22:07:56"),
    ("[15/Jan/2024:14:30:22 +0530]", "2024-01-15 09:00:22"), ("25/01/2024 14:30:22", "2024-01-25 14:30:22"), ("01/25/2024 14:30:22", "2024-01-25 14:30:22"), ("03/04/2024 14:30:22", "2024-03-04 14:30:22"),
    ("10,01/15/24,10:30:22,x", "2024-01-15 10:30:22"), ("Jan 15, 2024 14:30:22", "2024-01-15 14:30:22"), ("Jan  5 14:30:22 host", "2024-01-05 14:30:22"), ("20240115T143022", "2024-01-15 14:30:22"),
    ("1705329022.5 x", "2024-01-15 14:30:22"), ("1705329022123 x", "2024-01-15 14:30:22"), ("day 15.02.2026", "2026-02-15 00:00:00"), ("14:30:22.5 tick", "2024-06-01 14:30:22.500000"), ("nothing", None),
]


def test_sniffing(spark):
    df = spark.createDataFrame(SNIFFED, "text string, want string").withColumn("got", sniff_timestamp(F.col("text"), AS_OF))
    assert [(r.text, str(r.got) if r.got else None) for r in df.collect()] == SNIFFED


def test_timestamp_chain(spark):
    def one(text, fmt):
        v = spark.range(1).select(parse_timestamp(F.lit(text), fmt, AS_OF)).first()[0]
        return str(v) if v else None

    assert one("15/Jan/2024:14:30:22 +0530", "%d/%b/%Y:%H:%M:%S %z") == "2024-01-15 09:00:22"
    assert one("1-5-2024", "%m-%d-%Y") == "2024-01-05 00:00:00"
    assert one("2024-01-15T14:30:22Z", "%d.%m.%Y") == "2024-01-15 14:30:22"
    assert one("Jan  5 14:30:22", "%b %d %H:%M:%S") == "2024-01-05 14:30:22"
    assert one("rubbish", "%Y-%m-%d") is None
    assert has_offset("%H:%M %:z") and not has_offset("%%z") and spark_format("%-m/%-d/%Y %p") == "M/d/yyyy a"


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    for text, want in (
        ("Connection from 192.168.1.100:8080 refused", "Connection from <IP> refused"), ("Session 550e8400-e29b-41d4-a716-446655440000 expired", "Session <GUID> expired"),
        ("Error at address 0xDEADBEEF01234567", "Error at address <HEX>"), ("Processed 42 items in 3.14 seconds", "Processed <NUM> items in <NUM> seconds"),
    ):
        assert one(normalize_message(F.lit(text))) == want
    assert one(truncate_bytes(F.lit("aé" * 3), 5)) == "aéa... [truncated]" and one(truncate_bytes(F.lit("abc"), 3)) == "abc"
    assert one(preview(F.lit("a\x01b\tc\nd"))) == "a�b\tc" and one(preview(F.lit("x" * 150))) == "x" * 140 + "…"


def test_profiles_are_checked(spark, tmp_path):
    assert len(BY_ID) == 22 and all(not problems(p) for p in BY_ID.values())
    spark.range(1).select(*[F.lit("").rlike(java_regex(p.line)) for p in BY_ID.values()]).collect()
    bad = Profile("x", "x", "(", "^(?P<message>.+)$")
    assert problems(bad)
    own = '[profile]\nid = "plain-text"\nname = "Mine"\n[detection]\ncontent_match = "x"\n[parsing]\nline_pattern = "^(?P<message>.+)$"\nmultiline_mode = "raw"\n'
    (tmp_path / "a.toml").write_text(own)
    (tmp_path / "b.toml").write_text("not toml [")
    loaded, skipped = load_profiles(str(tmp_path))
    assert len(loaded) == 22 and loaded[21].name == "Mine" and len(skipped) == 1
    with pytest.raises(ValueError):
        register_profile(loaded, bad)


def test_tier_hints(spark):
    """The tier that most of a file's first lines need; the others still find what it doesn't."""
    from logweir.operators import parse

    lines = [("a", i, f"at 2024/01/05 10:00:0{i % 10}") for i in range(1, 8)] + [("a", 8, "at 05.01.2024 11:00:00"), ("a", 9, "none")]
    lines += [("b", i, "none") for i in range(1, 4)] + [("c", 1, "2024-01-05T10:00:00Z"), ("c", 2, "5 Jan"), ("d", 500, "2024-01-05 10:00:00")]
    df = spark.createDataFrame(lines, "source_file string, line_number long, line string")
    hints = parse.tier_hints(df, AS_OF)
    assert sorted(tuple(r) for r in hints.collect()) == [("a", 3), ("c", 0)]
    plain = next(p for p in builtin_profiles() if p.id == "plain-text")
    key = lambda rows: sorted((r.source_file, r.line_number, r.timestamp) for r in rows.where("timestamp is not null").collect())
    assert key(parse.parse_lines(df, plain, AS_OF, hints)) == key(parse.parse_lines(df, plain, AS_OF)) and len(key(parse.parse_lines(df, plain, AS_OF, hints))) == 10

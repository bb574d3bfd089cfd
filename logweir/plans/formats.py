"""More registered queries: the other format profiles, timestamp chain and tiers, detection by name, text functions, entries."""

from __future__ import annotations

import shutil
import tempfile
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import text, timestamps
from ..operators import analyse, detect, filters, parse, search
from ..sources.profiles import builtin_profiles, load_profiles, register_profile
from ..streaming import follow
from .lenses import documents_lens, events_lens, rendered
from .registry import AS_OF, _RENDER, profile, query


def _word(words: dict[str, str]):
    """A word for each severity, ``other`` for those not named, as a column; columns need a session, so only queries call this."""
    named = [F.when(F.col("severity") == k, v) for k, v in words.items() if k != "other"]
    return F.coalesce(*named, F.lit(words.get("other", "")))


def _word_sql(words: dict[str, str]) -> str:
    """:func:`_word` in SQL."""
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items() if k != "other")
    return f"(CASE severity {named} ELSE '{words.get('other', '')}' END)"


def _stamp(fmt: str):
    return F.date_format("timestamp", fmt)


def _roundtrip(profile_id: str, line, severity: str, message: str, thread: str = "NULL", component: str = "NULL", time: str = "date_trunc('second', timestamp)") -> None:
    """``line`` renders an entry of the lens; the others are SQL for what parsing gives back."""

    def run(spark, sf_dir):
        got = parse.parse_lines(rendered(events_lens(spark, sf_dir), line()), profile(profile_id), AS_OF)
        return got.select("timestamp", "severity", "source_file", "line_number", "thread", "component", "message")

    query(
        f"SELECT {time} AS timestamp, {severity} AS severity, source_file, line_number, ({thread})::VARCHAR AS thread, ({component})::VARCHAR AS component, {message} AS message FROM e",
        "parse_roundtrip_" + profile_id.replace("-", "_"),
    )(run)


_ONLY = "CASE WHEN severity IN ({}) THEN severity ELSE '{}' END"
_STATUS = dict(Error="500", Warning="404", other="200")
_TAGS = dict(Error="[ERROR] ", Warning="[WARN] ", Info="[INFO] ", Debug="[DEBUG] ")
_SYSLOG = dict(Error="err ", Warning="warn ", Info="notice ", Debug="debug ")


def _register_roundtrips() -> None:
    word, sql = _word, _word_sql
    mail, server = dict(Error="FAIL", Warning="DELAY", other="SEND"), dict(Error="failed to ", Warning="timeout ", Info="completed ", Debug="dbcc ")
    lease, box = dict(Error="Nack", Warning="Expired", Info="Renew", other="Other"), dict(Error="Error: ", Warning="Warning: ")
    level, flag = dict(Error="error", Warning="warn", Info="info", Debug="debug", other="none"), dict(Error="!", Warning="?", other="+")
    seen = "CASE WHEN severity IN ('Error', 'Warning') THEN severity ELSE 'Info' END"
    _roundtrip(
        "apache-combined", lambda: F.concat("thread", F.lit(" - - ["), _stamp("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), F.col("id").cast("string"), F.lit(' HTTP/1.1" '), word(_STATUS), F.lit(' 5 "-" "-"')),
        _ONLY.format("'Error', 'Warning'", "Unknown"), f"""'"GET /' || id || ' HTTP/1.1" ' || {sql(_STATUS)} || ' 5 "-" "-"'""", component="thread",
    )
    _roundtrip("exchange-tracking", lambda: F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123Z,SMTP,"), word(mail), F.lit(","), "message"), seen, f"'SMTP,' || {sql(mail)} || ',' || message")
    _roundtrip("iis-w3c", lambda: F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" GET /p - "), word(_STATUS), F.lit(" 0 "), "component"), _ONLY.format("'Error', 'Warning'", "Unknown"), f"'GET /p - ' || {sql(_STATUS)} || ' 0 ' || component")
    kinds = dict(Error="3", Warning="2", Info="1", other="0")
    _roundtrip(
        "intune-ime", lambda: F.format_string('<![LOG[%s]LOG]!><time="07:12:48.905+060" date="%s" component="%s" context="" type="%s" thread="%s" file="x.cpp">', "message", _stamp("M-d-yyyy"), "component", word(kinds), "thread"),
        _ONLY.format("'Error', 'Warning', 'Info'", "Unknown"), "message", "thread", "component", "date_trunc('day', timestamp)",
    )
    _roundtrip(
        "json-lines", lambda: F.concat(F.lit('{"timestamp":"'), _stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z","level":"'), word(level), F.lit('","user":"'), "thread", F.lit('"}')), "severity",
        f"""'{{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || 'Z","level":"' || {sql(level)} || '","user":"' || thread || '"}}'""",
    )
    letter = dict(Error="E", Warning="W", other="I")
    _roundtrip(
        "kubernetes-klog", lambda: F.concat(word(letter), _stamp("MMdd HH:mm:ss"), F.lit(".123456       1 a.go:78] "), "message"), seen, "message",
        time="TIMESTAMP '2024-01-20' + (date_trunc('second', timestamp) - date_trunc('day', timestamp)) + INTERVAL 123456 MICROSECOND",
    )
    _roundtrip("sql-server-agent", lambda: F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" - "), word(flag), F.lit(" ["), "thread", F.lit("] "), "message"), "CASE severity WHEN 'Error' THEN severity ELSE 'Info' END", "message", "thread")
    _roundtrip("sql-server-error", lambda: F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), F.lit(".78 "), "component", F.lit("      "), word(server), "message"), "severity", f"{sql(server)} || message", component="component")
    _roundtrip(
        "syslog-rfc3164", lambda: F.concat(_stamp("MMM"), F.lit(" "), F.lpad(_stamp("d"), 2, " "), F.lit(" "), _stamp("HH:mm:ss"), F.lit(" "), "component", F.lit(" app["), "thread", F.lit("]: "), word(_SYSLOG), "message"),
        "severity", f"{sql(_SYSLOG)} || message", "thread", "component", "date_trunc('second', timestamp) + to_years((2024 - year(timestamp))::INT)",
    )
    _roundtrip(
        "syslog-rfc5424", lambda: F.concat(F.lit("<34>1 "), _stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z "), "component", F.lit(" app "), "thread", F.lit(" ID1 - "), word(_SYSLOG), "message"),
        "severity", f"{sql(_SYSLOG)} || message", "thread", "component", "date_trunc('second', timestamp) + INTERVAL 250 MILLISECOND",
    )
    _roundtrip("windows-dhcp", lambda: F.concat("thread", F.lit(","), _stamp("MM/dd/yy','HH:mm:ss"), F.lit(","), word(lease), F.lit(","), "message"), _ONLY.format("'Error', 'Warning', 'Info'", "Unknown"), f"{sql(lease)} || ',' || message", "thread")
    _roundtrip("generic-timestamp", lambda: F.concat(_stamp("yyyy/MM/dd HH:mm:ss"), F.lit(" "), word(_TAGS), "message"), "severity", f"{sql(_TAGS)} || message")
    _roundtrip("plain-text", lambda: F.concat(word(_TAGS), "message"), "severity", f"{sql(_TAGS)} || message", time="NULL::TIMESTAMP")
    _roundtrip("veeam-vbo365", lambda: F.concat(_stamp("M/d/yyyy h:mm:ss a"), F.lit(" 7 ("), "thread", F.lit(") "), word(box), "message"), _ONLY.format("'Error', 'Warning'", "Unknown"), f"{sql(box)} || message", "thread", "'7'")


_register_roundtrips()


# --------------------------------------------------------------------------- timestamps
@query("""
SELECT id, CASE tier WHEN 0 THEN date_trunc('second', timestamp) WHEN 1 THEN date_trunc('second', timestamp) WHEN 2 THEN date_trunc('day', timestamp)
  ELSE TIMESTAMP '2024-01-20' + (date_trunc('second', timestamp) - date_trunc('day', timestamp)) END AS timestamp
FROM (SELECT *, (id % 4)::INT AS tier FROM e)""")
def sniff_more_tiers(spark, sf_dir):
    """Seconds and milliseconds since 1970 (of which the tier of ten digits takes the seconds), dates alone, clocks alone."""
    shape = F.coalesce(
        F.when(F.col("id") % 4 == 0, F.unix_seconds("timestamp").cast("string")), F.when(F.col("id") % 4 == 1, F.unix_millis("timestamp").cast("string")),
        F.when(F.col("id") % 4 == 2, F.concat(F.lit("on "), _stamp("dd.MM.yyyy"))), F.concat(F.lit("at "), _stamp("HH:mm:ss")),
    )
    return events_lens(spark, sf_dir).select("id", timestamps.sniff_timestamp(F.concat(shape, F.lit(" x")), AS_OF).alias("timestamp"))


#: what is written, the format it is read by
_CHAIN = (("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("M-d-yyyy", "%m-%d-%Y"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%d.%m.%Y"), ("yyyy/MM/dd'T'HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("MMM d HH:mm:ss", "%b %d %H:%M:%S"), ("HH:mm", "%Y-%m-%d"))


@query("""
SELECT id, CASE step WHEN 1 THEN date_trunc('day', timestamp) WHEN 4 THEN date_trunc('second', timestamp) + to_years((2024 - year(timestamp))::INT)
  WHEN 5 THEN NULL ELSE date_trunc('second', timestamp) END AS timestamp
FROM (SELECT *, (id % 6)::INT AS step FROM e)""")
def timestamp_chain(spark, sf_dir):
    """A format itself, as a date, RFC 3339 in its place, other separators, without a year, and no match."""
    each = [F.when(F.col("id") % len(_CHAIN) == i, timestamps.parse_timestamp(_stamp(f), g, AS_OF)) for i, (f, g) in enumerate(_CHAIN)]
    return events_lens(spark, sf_dir).select("id", F.coalesce(*each).alias("timestamp"))


_ZONED = (("dd/MMM/yyyy:HH:mm:ss '+0530'", "%d/%b/%Y:%H:%M:%S %z"), ("yyyy-MM-dd HH:mm:ss'-07:00'", "%Y-%m-%d %H:%M:%S%:z"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"))


@query("""
SELECT id, date_trunc('second', timestamp) + to_minutes(CASE step WHEN 0 THEN -330 WHEN 1 THEN 420 ELSE 0 END) AS timestamp, step < 2 AS zoned
FROM (SELECT *, (id % 3)::INT AS step FROM e)""")
def timestamp_offsets(spark, sf_dir):
    """Formats with an offset, which is applied, and one without."""
    each = [F.when(F.col("id") % 3 == i, timestamps.parse_timestamp(_stamp(f), g, AS_OF)) for i, (f, g) in enumerate(_ZONED)]
    zoned = F.coalesce(*[F.when(F.col("id") % 3 == i, F.lit(timestamps.has_offset(g))) for i, (_, g) in enumerate(_ZONED)])
    return events_lens(spark, sf_dir).select("id", F.coalesce(*each).alias("timestamp"), zoned.alias("zoned"))


# --------------------------------------------------------------------------- detection and parsing
_OWN = """
[profile]
id = "own-format"
name = "Pipes"
[detection]
content_match = '^\\d{4}/\\d\\d/\\d\\d \\d\\d\\|'
[parsing]
line_pattern = '^(?P<timestamp>[^|]*)\\|(?P<level>\\w+)\\|(?P<thread>\\w*)\\|(?P<message>.*)$'
timestamp_format = "%Y/%m/%d %H"
multiline_mode = "skip"
[severity_mapping]
error = ["BAD"]
warning = ["ODD"]
"""


@query("""
SELECT source_file, id AS line_number, CASE WHEN severity IN ('Error', 'Warning') THEN severity ELSE 'Unknown' END AS severity, thread, message,
  date_trunc('hour', timestamp) AS timestamp, 'own-format' AS profile_id, 1::BIGINT AS skipped FROM e""")
def user_profiles(spark, sf_dir):
    """A folder of a user's profiles, one of which can't be used; files are detected and parsed by the other."""
    folder = Path(tempfile.mkdtemp(prefix="profiles-"))  # read by the driver alone, at once
    (folder / "own.toml").write_text(_OWN)
    (folder / "broken.toml").write_text(_OWN.replace("own-format", "broken").replace("skip", "sideways"))
    profiles, skipped = load_profiles(str(folder))
    shutil.rmtree(folder)
    lens = events_lens(spark, sf_dir)
    level = F.coalesce(F.when(F.col("severity") == "Error", "BAD"), F.when(F.col("severity") == "Warning", "ODD"), F.lit("FINE"))
    lines = rendered(lens, F.concat_ws("|", _stamp("yyyy/MM/dd HH"), level, "thread", "message"))
    order = F.row_number().over(analyse.Window.partitionBy("source_file").orderBy("line_number"))
    found = detect.detect_formats(lines.withColumn("line_number", order), lens.select(F.col("source_file").alias("path")).distinct(), profiles)
    got = parse.parse_all(lines, found, profiles, AS_OF)
    return got.select("source_file", "line_number", "severity", "thread", "message", "timestamp", "profile_id", F.lit(len(skipped)).cast("long").alias("skipped"))


@query("""
SELECT source_file, id AS line_number, upper(event) AS message FROM (SELECT *, component AS event FROM e)""")
def replaced_profile(spark, sf_dir):
    """A profile of the same id takes the place of a built-in one."""
    own = register_profile(builtin_profiles(), replace(profile("log4j-default"), content="^#", line=r"^# (?P<message>.*)$", format="", mode="skip"))
    by_id = next(p for p in own if p.id == "log4j-default")
    lines = rendered(events_lens(spark, sf_dir), F.concat(F.lit("# "), F.upper("component")))
    return parse.parse_lines(lines, by_id, AS_OF).select("source_file", "line_number", "message")


@query("""
SELECT source_file, id AS line_number, CASE WHEN id % 3 = 1 THEN date_trunc('second', timestamp) ELSE TIMESTAMP '2024-01-20' END AS timestamp, CASE WHEN id % 3 = 1 THEN message ELSE component END AS message
FROM (SELECT *, min(CASE WHEN id % 3 <> 0 THEN id END) OVER (PARTITION BY source_file) AS head FROM e) WHERE id % 3 <> 0""")
def followed_batch(spark, sf_dir):
    """A micro-batch: what stands before its first entry is dropped, entries without a time get the batch's; a line in three continues nothing and is skipped."""
    lens = events_lens(spark, sf_dir)
    raw = F.when(F.col("id") % 3 == 1, F.concat(_stamp("yyyy/MM/dd HH:mm:ss"), F.lit(" | "), "message")).when(F.col("id") % 3 == 2, F.concat(F.lit("undated | "), "component")).otherwise(F.lit("  at nothing"))
    own = replace(profile("nginx-error"), id="own", line=r"^(?P<timestamp>.*?) \| (?P<message>.*)$", format="%Y/%m/%d %H:%M:%S", mode="skip", levels={}, overrides={})
    return follow.parse_batch(rendered(lens, raw), own, AS_OF).select("source_file", "line_number", "timestamp", "message")


@query("""
SELECT source_file, id AS line_number FROM (SELECT *, min(CASE WHEN id % 5 = 2 THEN id END) OVER (PARTITION BY source_file) AS head FROM e) WHERE id % 5 = 2""")
def followed_orphans(spark, sf_dir):
    """Continuation lines at the start of a batch have no entry and are dropped; later ones belong to theirs."""
    lens = events_lens(spark, sf_dir)
    raw = F.when(F.col("id") % 5 == 2, _RENDER["log4j-default"][0]()).otherwise(F.concat(F.lit("  at "), "component"))
    return follow.parse_batch(rendered(lens, raw), profile("log4j-default"), AS_OF).select("source_file", "line_number")


_NAMED = "CASE WHEN source_file IN ('user_0.log', 'user_5.log') THEN '/var/access.log' WHEN source_file = 'user_1.log' THEN '/var/u_ex' || right(left(source_file, 6), 1) || '.log' ELSE source_file END"


@query(f"""
SELECT path, CASE WHEN path = '/var/access.log' THEN 'apache-combined' WHEN path = '/var/u_ex1.log' THEN 'iis-w3c' ELSE 'plain-text' END AS profile_id,
  CASE WHEN path = '/var/access.log' THEN 0.3 WHEN path = '/var/u_ex1.log' THEN 1.0 ELSE 0.0 END::DOUBLE AS detection_confidence
FROM (SELECT DISTINCT {_NAMED} AS path FROM e)""")
def detect_by_name(spark, sf_dir):
    """A name alone, a name on top of the lines, and neither."""
    lens = events_lens(spark, sf_dir)
    name = F.when(F.col("source_file").isin("user_0.log", "user_5.log"), "/var/access.log").when(F.col("source_file") == "user_1.log", "/var/u_ex1.log").otherwise(F.col("source_file"))
    lens = lens.withColumn("source_file", name)
    body = F.when(F.col("source_file") == "/var/u_ex1.log", F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" GET /p - 200 0"))).otherwise(F.concat(F.lit("## "), "component"))
    order = F.row_number().over(analyse.Window.partitionBy("source_file").orderBy("line_number"))
    lines = rendered(lens, body).where(F.col("source_file") != "/var/access.log").withColumn("line_number", order)
    return detect.detect_formats(lines, lens.select(F.col("source_file").alias("path")), builtin_profiles())


@query("""SELECT source_file, CASE WHEN source_file = 'user_3.log' THEN 'plain-text' WHEN source_file = 'user_4.log' THEN 'plain-text' ELSE 'nginx-error' END AS profile_id, count(*) AS n FROM e GROUP BY 1, 2""")
def parse_falls_back(spark, sf_dir):
    """A file whose profile fits no line, and one that detection doesn't know, are plain text."""
    lens = events_lens(spark, sf_dir)
    lines = rendered(lens, F.when(F.col("source_file") == "user_3.log", F.col("message")).otherwise(_RENDER["nginx-error"][0]()))
    found = lens.where("source_file <> 'user_4.log'").select(F.col("source_file").alias("path"), F.lit("nginx-error").alias("profile_id")).distinct()
    return parse.parse_all(lines, found, builtin_profiles(), AS_OF).groupBy("source_file", "profile_id").agg(F.count("*").alias("n"))


@query("""
SELECT source_file, id AS line_number, 'line' AS reason FROM (SELECT *, min(CASE WHEN id % 10 = 7 THEN id END) OVER (PARTITION BY source_file) AS head FROM e)
WHERE head IS NULL OR id < head""")
def leading_orphans(spark, sf_dir):
    """Lines before a file's first entry."""
    lens = events_lens(spark, sf_dir)
    lines = rendered(lens, F.when(F.col("id") % 10 == 7, _RENDER["log4j-default"][0]()).otherwise(F.concat(F.lit("  at "), "message")))
    return parse.parse_errors(lines, profile("log4j-default"), AS_OF, most=1 << 30)


@query("""
SELECT max(id) AS line_number, 'Error' AS severity, min(n) AS lines FROM (SELECT 3 * id + 1 AS id, 2 AS n FROM e) GROUP BY id""")
def severity_of_first_line(spark, sf_dir):
    """An entry has the severity of its first line, whatever the next says."""
    lens = events_lens(spark, sf_dir)
    parts = F.array(F.format_string("%s,123 ERROR [m] c - first", _stamp("yyyy-MM-dd HH:mm:ss")), F.lit("FATAL CRITICAL warning"))
    lines = lens.select("source_file", "id", F.posexplode(parts).alias("i", "line")).select("source_file", (3 * F.col("id") + F.col("i") + 1).alias("line_number"), "line")
    got = parse.parse_lines(lines, profile("log4j-default"), AS_OF)
    return got.select("line_number", "severity", F.size(F.split("message", "\n")).cast("long").alias("lines"))


@query("SELECT row_number() OVER (ORDER BY source_file, line_number NULLS LAST, timestamp, message) - 1 + 100 AS id, message FROM (SELECT * REPLACE (CASE WHEN id % 3 <> 0 THEN line_number END AS line_number) FROM e)")
def assign_ids_without_lines(spark, sf_dir):
    """Rows without a line number, as event records may be, keep their place in their file; numbers go on from a start."""
    lens = events_lens(spark, sf_dir).withColumn("line_number", F.when(F.col("id") % 3 != 0, F.col("line_number"))).drop("id", "raw_text")
    return parse.assign_ids(lens, 100).select("id", "message")


@query("SELECT greatest(max(id), 500) + 1 AS next FROM e")
def next_id(spark, sf_dir):
    lens = events_lens(spark, sf_dir)
    return spark.range(1).select(F.lit(parse.next_id(lens, 500)).cast("long").alias("next"))


@query("SELECT id, message FROM e WHERE id < 1000")
def cap_entries(spark, sf_dir):
    return parse.cap_entries(events_lens(spark, sf_dir), 1000).select("id", "message")


@query("SELECT id, severity FROM e WHERE severity IN ('Critical', 'Error')")
def only_errors(spark, sf_dir):
    return parse.only_errors(events_lens(spark, sf_dir)).select("id", "severity")


@query("SELECT id, source_file FROM e WHERE source_file NOT IN ('user_2.log', 'user_7.log')")
def remove_files(spark, sf_dir):
    lens = events_lens(spark, sf_dir)
    return parse.remove_files(lens, lens.where(F.col("source_file").isin("user_2.log", "user_7.log")).select(F.col("source_file").alias("path"))).select("id", "source_file")


# --------------------------------------------------------------------------- filters, search, order
@query("SELECT id, severity FROM e WHERE severity IN ('Critical', 'Error', 'Warning') AND timestamp >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 900 SECOND")
def filter_preset(spark, sf_dir):
    """Errors and warnings of the last 15 minutes."""
    spec = filters.FilterSpec.recent_problems()
    return filters.apply_filters(events_lens(spark, sf_dir), spec, datetime(2024, 1, 15, 12, tzinfo=timezone.utc)).select("id", "severity")


@query("SELECT id, timestamp FROM e WHERE timestamp BETWEEN TIMESTAMP '2024-01-09 23:00:00' AND TIMESTAMP '2024-01-11 22:59:59'")
def filter_user_dates(spark, sf_dir):
    """Days as a user in Berlin writes them."""
    moment = lambda t, end: filters.parse_moment(t, "Europe/Berlin", end)
    spec = filters.FilterSpec(start=moment("2024-01-10", False), end=moment("2024-01-11", True))
    return filters.apply_filters(events_lens(spark, sf_dir), spec, AS_OF).select("id", "timestamp")


@query("SELECT 'severity: Critical, Error; time: 2024-01-05 00:00:00+00:00 to ...; text: view; timed only' AS filters, count(*) AS n FROM e WHERE severity IN ('Critical', 'Error') AND timestamp >= TIMESTAMP '2024-01-05' AND contains(message, 'view')")
def filter_described(spark, sf_dir):
    """The words of a filter beside what it lets through."""
    spec = filters.FilterSpec(severities=frozenset({"Critical", "Error"}), start=datetime(2024, 1, 5, tzinfo=timezone.utc), text="view", hide_untimed=True)
    return filters.apply_filters(events_lens(spark, sf_dir), spec, AS_OF).agg(F.count("*").alias("n")).select(F.lit(spec.describe()).alias("filters"), "n")


@query("SELECT id FROM e WHERE regexp_matches(lower(message), 'err') AND NOT contains(component, 'view')")
def multi_on_column(spark, sf_dir):
    """A search in one column of one's own."""
    lens = events_lens(spark, sf_dir)
    return lens.where(search.MultiSearch.parse("ERR, -view").to_column(F.col("message"))).select("id")


_TERMS = ("error", "or", "1")
_COVER = " OR ".join(f"substr(t, (p - {k})::INT, {len(w)}) = '{w}'" for w in _TERMS for k in range(len(w)))


@query(f"""
SELECT id, coalesce(to_json(list_transform(list_zip(list_filter(ps, lambda p: c[p] AND NOT (p > 1 AND c[p - 1])), list_filter(ps, lambda p: c[p] AND NOT (p < len(c) AND c[p + 1]))),
  lambda z: {{'start': z[1] - 1, 'end': z[2]}}))::VARCHAR, '[]') AS ranges
FROM (SELECT id, t, range(1, length(t) + 1) AS ps, list_transform(range(1, length(t) + 1), lambda p: {_COVER}) AS c FROM (SELECT id, ' ' || lower(message) AS t FROM e))""".replace("z[1] - 1", "z[1] - 2").replace("'end': z[2]", "'end': z[2] - 1"))
def highlight(spark, sf_dir):
    """Byte ranges of three terms in every message; SQL has them from the characters that a term covers."""
    lens = events_lens(spark, sf_dir)
    return lens.select("id", F.to_json(search.highlight(F.col("message"), search.MultiSearch.parse("error, or, 1"))).alias("ranges"))


@query("SELECT id, timestamp FROM u WHERE timestamp > TIMESTAMP '2024-01-10' OR (timestamp = TIMESTAMP '2024-01-10' AND id > 50) OR timestamp IS NULL ORDER BY timestamp NULLS LAST, id LIMIT 500")
def timeline_page(spark, sf_dir):
    """The page behind a row."""
    return analyse.timeline(events_lens(spark, sf_dir, untimed=True), after=(datetime(2024, 1, 10, tzinfo=timezone.utc), 50), limit=500).select("id", "timestamp")


@query("""SELECT s.id, e.id AS occurrence_id, e.timestamp, e.line_number, row_number() OVER (PARTITION BY s.id ORDER BY e.timestamp NULLS FIRST, e.id) - 1 AS position
FROM u e JOIN (SELECT source_file, message, arg_max(id, (coalesce(epoch_us(timestamp), -1), id)) AS id FROM u GROUP BY 1, 2) s ON s.source_file = e.source_file AND s.message = e.message""")
def dedup_expanded(spark, sf_dir):
    """A row for each occurrence of each message."""
    got = analyse.expand_occurrences(analyse.dedup(events_lens(spark, sf_dir, untimed=True)))
    return got.select("id", "occurrence_id", "timestamp", "line_number", F.col("position").cast("long").alias("position"))


@query("SELECT id, timestamp FROM (SELECT source_file, arg_max(id, (coalesce(epoch_us(timestamp), -1), id)) AS id, max(timestamp) AS timestamp FROM u GROUP BY source_file, message) ORDER BY timestamp NULLS LAST, id LIMIT 300")
def dedup_in_order(spark, sf_dir):
    """The timeline of what dedup leaves."""
    return analyse.timeline(analyse.survivors(events_lens(spark, sf_dir, untimed=True)), limit=300).select("id", "timestamp")


@query("SELECT id, source_file, CASE WHEN source_file IN ('user_1.log', 'user_4.log') THEN TIMESTAMP '2024-02-01' ELSE file_modified END AS file_modified FROM u")
def refresh_modified(spark, sf_dir):
    """Newer modification times where there are any."""
    lens = events_lens(spark, sf_dir, untimed=True)
    files = lens.where(F.col("source_file").isin("user_1.log", "user_4.log")).select(F.col("source_file").alias("path"), F.lit(datetime(2024, 2, 1, tzinfo=timezone.utc)).alias("modified")).distinct()
    return analyse.refresh_modified(lens, files).select("id", "source_file", "file_modified")


@query("SELECT id, message, 'see ' || id AS label FROM e WHERE id % 101 = 0")
def bookmarks(spark, sf_dir):
    lens = events_lens(spark, sf_dir)
    marks = lens.where(F.col("id") % 101 == 0).select("id", F.concat(F.lit("see "), F.col("id").cast("string")).alias("label"))
    return analyse.bookmarks(lens, marks).select("id", "message", "label")


@query("SELECT severity, count(*) AS n FROM (SELECT severity FROM e UNION ALL SELECT severity FROM u) GROUP BY 1")
def union_of_tables(spark, sf_dir):
    """Scanned and followed entries together."""
    both = events_lens(spark, sf_dir).unionByName(events_lens(spark, sf_dir, untimed=True))
    return both.groupBy("severity").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- text
@query("""
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(line) > 140 THEN left(line, 140) || '…' ELSE line END AS preview
FROM (SELECT doc_id, text, regexp_replace(coalesce(string_split(text, chr(10))[1], ''), '[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x{9F}]', chr(65533), 'g') AS line FROM documents)""")
def previews(spark, sf_dir):
    """The first lines of the documents, cut."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("""
SELECT doc_id, CASE WHEN strlen(text) > 200 THEN left(text, list_max(list_filter(range(0, 201), lambda k: strlen(left(text, k)) <= 200))) || '... [truncated]' ELSE text END AS cut
FROM documents""")
def truncated(spark, sf_dir):
    """At most 200 bytes of every document, cut between characters."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.truncate_bytes(F.col("text"), 200).alias("cut"))


@query("""
SELECT id, upper(left(severity, 4)) AS label, strftime(timestamp, '%Y-%m-%d %H:%M:%S UTC') AS utc, strftime(date_trunc('second', timestamp), '%Y-%m-%dT%H:%M:%S+00:00') AS rfc, right(source_file, 6) AS name,
  source_file LIKE 'user\\_3%' ESCAPE '\\' OR source_file LIKE '%\\_8.log' ESCAPE '\\' AS globbed FROM e""")
def text_functions(spark, sf_dir):
    """Labels, times as text, base names, globs."""
    lens = events_lens(spark, sf_dir)
    path = F.concat(F.lit("/var/x/"), F.substring("source_file", 1, 4), F.lit("/"), F.substring("source_file", -6, 6))
    return lens.select(
        "id", text.short_label(F.col("severity")).alias("label"), text.format_utc(F.col("timestamp")).alias("utc"), text.rfc3339(F.date_trunc("second", "timestamp")).alias("rfc"),
        text.base_name(path).alias("name"), text.matches_glob(F.col("source_file"), ["user_3*", "*_[8].log"]).alias("globbed"),
    )


@query("SELECT doc_id, line_number, trim(regexp_replace(line, '[\\s\\x0B]+', ' ', 'g'), ' ') AS line FROM l")
def collapsed_space(spark, sf_dir):
    """Lines of the documents with their white space in one piece."""
    return documents_lens(spark, sf_dir).select("doc_id", F.col("line_number"), text.collapse_space(F.col("line")).alias("line"))

"""Registered queries over the driver's tables, with DuckDB SQL for each that SQL can express.

All of them read whole tables.  The session's time zone is set to UTC, as entries are in UTC.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_message
from ..operators import analyse, correlate, detect, filters, parse, search
from ..sources.event_xml import read_event_xml
from ..sources.profiles import builtin_profiles
from .lenses import documents_lens, events_lens, ntz, rendered

AS_OF = datetime(2024, 1, 20, tzinfo=timezone.utc)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The events lens in SQL.  Fixed values: the severity words of the plain-text profile in ``_KEYWORDS`` below.
LENS = """
WITH e AS (
  SELECT event_id AS id, ts AS timestamp,
    CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' WHEN 'purchase' THEN 'Info' WHEN 'click' THEN 'Debug' ELSE 'Unknown' END AS severity,
    'user_' || (user_id % 10) || '.log' AS source_file, event_id AS line_number, user_id::VARCHAR AS thread, event_type AS component,
    event_type || ' ' || props AS message
  FROM events),
u AS (SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN timestamp END AS timestamp), date_trunc('day', timestamp) AS file_modified FROM e),
l AS (SELECT source AS source_file, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)
"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` follows the lens."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return ntz(f(spark, sf_dir))

        QUERIES[name or f.__name__] = run
        if sql is not None:
            SQL[name or f.__name__] = LENS + sql
        return f

    return add


def profile(profile_id: str):
    return next(p for p in builtin_profiles() if p.id == profile_id)


# --------------------------------------------------------------------------- parsing
def _stamp(fmt: str):
    return F.date_format("timestamp", fmt)


def _level(words: dict[str, str]):
    return F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in words.items()], F.lit("NOTE"))


def _words(words: dict[str, str]) -> dict[str, str]:
    return {"Error": "ERROR", "Warning": "WARN", "Info": "INFO", "Debug": "DEBUG"} | words


#: profile -> a line for an entry of the lens, and in SQL what its severity and component become
_RENDER = {
    "log4j-default": (lambda: F.format_string("%s,123 %s [%s] %s - %s", _stamp("yyyy-MM-dd HH:mm:ss"), _level(_words({})), "thread", "component", "message"), "severity", "component"),
    "nginx-error": (lambda: F.format_string("%s [%s] %s#%s: %s", _stamp("yyyy/MM/dd HH:mm:ss"), F.lower(_level(_words({}))), "thread", "thread", "message"), "severity", "NULL"),
    "postgresql-log": (lambda: F.format_string("%s UTC [%s] %s:  %s", _stamp("yyyy-MM-dd HH:mm:ss.SSS"), "thread", _level(_words({"Warning": "WARNING", "Unknown": "OTHER"})), "message"), "severity", "NULL"),
    "tomcat-catalina": (lambda: F.format_string("%s %s [%s] %s %s", _stamp("dd-MMM-yyyy HH:mm:ss.SSS"), _level({"Error": "SEVERE", "Warning": "WARNING", "Info": "INFO", "Debug": "FINE", "Unknown": "CONFIG"}), "thread", "component", "message"), "CASE severity WHEN 'Unknown' THEN 'Info' ELSE severity END", "component"),
    "windows-cluster": (lambda: F.format_string("00000fa0.%s::%s.001 %s %s", F.lpad("thread", 8, "0"), _stamp("yyyy/MM/dd-HH:mm:ss"), _level({"Error": "ERR", "Warning": "WARN", "Info": "INFO", "Debug": "DBG"}), "message"), "severity", "NULL"),
    "sccm-cmtrace": (lambda: F.format_string('<![LOG[%s]LOG]!><time="07:12:48.905+060" date="%s" component="%s" context="" type="%s" thread="%s" file="x.cpp">', "message", _stamp("M-d-yyyy"), "component", _level({"Error": "3", "Warning": "2", "Info": "1", "Debug": "0", "Unknown": "0"}), "thread"), "CASE WHEN severity IN ('Error', 'Warning', 'Info') THEN severity ELSE 'Unknown' END", "component"),
    "windows-firewall": (lambda: F.format_string("%s %s %s", _stamp("yyyy-MM-dd HH:mm:ss"), F.when(F.col("severity") == "Error", "DROP").otherwise("ALLOW"), "message"), "CASE severity WHEN 'Error' THEN 'Warning' ELSE 'Info' END", "NULL"),
    "veeam-vbr": (lambda: F.format_string("[%s] <%s> %s %s", _stamp("dd.MM.yyyy HH:mm:ss"), "thread", _level({"Error": "Error", "Warning": "Warning", "Info": "Info", "Debug": "Debug", "Unknown": "Critical"}), "message"), "CASE severity WHEN 'Unknown' THEN 'Critical' ELSE severity END", "NULL"),
}


def _known_levels():
    """A log4j line whose level is one of those that detection expects."""
    return F.format_string("%s,123 %s [%s] %s - %s", _stamp("yyyy-MM-dd HH:mm:ss"), _level(_words({"Unknown": "TRACE"})), "thread", "component", "message")


def _roundtrip(profile_id: str):
    text, severity, component = _RENDER[profile_id]
    unit = "day" if profile_id == "sccm-cmtrace" else "millisecond" if profile_id in ("postgresql-log", "tomcat-catalina") else "second"
    thread = {"nginx-error": "thread || '#' || thread", "windows-cluster": "'00000fa0.' || lpad(thread, 8, '0')", "windows-firewall": "NULL"}.get(profile_id, "thread")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lens = events_lens(spark, sf_dir)
        got = parse.parse_lines(rendered(lens, text()), profile(profile_id), AS_OF)
        return got.select("timestamp", "severity", "source_file", "line_number", "thread", "component", "message")

    query(
        f"SELECT date_trunc('{unit}', timestamp) AS timestamp, {severity} AS severity, source_file, line_number, ({thread})::VARCHAR AS thread, ({component})::VARCHAR AS component, message FROM e",
        "parse_roundtrip_" + profile_id.replace("-", "_"),
    )(run)


for _p in _RENDER:
    _roundtrip(_p)


@query("""
SELECT date_trunc('second', timestamp) AS timestamp, severity, source_file, 3 * id + 1 AS line_number,
  message || chr(10) || '  at ' || thread || chr(10) || '  end' AS message FROM e""")
def continuation_fold(spark, sf_dir):
    """Entries of three lines, of which only the first has a head."""
    lens = events_lens(spark, sf_dir)
    head = F.format_string("%s,123 %s [%s] %s - %s", _stamp("yyyy-MM-dd HH:mm:ss"), _level(_words({})), "thread", "component", "message")
    parts = F.array(head, F.concat(F.lit("  at "), "thread"), F.lit("  end"))
    lines = lens.select("source_file", "id", "file_modified", F.posexplode(parts).alias("i", "line")).select("source_file", (3 * F.col("id") + F.col("i") + 1).alias("line_number"), "line", "file_modified")
    return parse.parse_lines(lines, profile("log4j-default"), AS_OF).select("timestamp", "severity", "source_file", "line_number", "message")


_KEYWORDS = """CASE WHEN regexp_matches(line, '\\[CRIT(ICAL)?\\]|\\[FATAL\\]|\\bFatalException\\b') THEN 'Critical'
  WHEN regexp_matches(line, '\\[ERR(OR)?\\]|\\bException\\b|\\bStackTrace\\b|\\bUnhandled\\b') THEN 'Error'
  WHEN regexp_matches(line, '\\[WARN(ING)?\\]|\\bDeprecated\\b') THEN 'Warning'
  WHEN regexp_matches(line, '\\[INFO(RMATION)?\\]') THEN 'Info' WHEN regexp_matches(line, '\\[DEBUG\\]|\\[VERBOSE\\]|\\[TRACE\\]') THEN 'Debug'
  WHEN contains(lower(line), 'critical') OR contains(lower(line), 'fatal') THEN 'Critical'
  WHEN contains(lower(line), 'error') OR contains(lower(line), 'fail') OR contains(lower(line), 'exception') THEN 'Error'
  WHEN contains(lower(line), 'warn') THEN 'Warning' ELSE 'Unknown' END"""


@query(f"SELECT source_file, count(*) AS n, count_if(sev <> 'Unknown') AS known, sum(strlen(line))::BIGINT AS bytes FROM (SELECT *, {_KEYWORDS} AS sev FROM l WHERE NOT regexp_matches(line, '^[\\s\\x0B]*$')) GROUP BY 1")
def raw_mode(spark, sf_dir):
    """Every line that isn't blank is an entry of its own."""
    lines = documents_lens(spark, sf_dir)
    got = parse.parse_lines(lines.select("source_file", (F.col("doc_id") * 100_000 + F.col("line_number")).alias("line_number"), "line"), profile("plain-text"), AS_OF)
    return got.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.col("severity") != "Unknown").alias("known"), F.sum(F.octet_length("message")).alias("bytes"))


@query("SELECT source_file, least(count(*), 1000) AS n, 'line' AS reason FROM l WHERE NOT regexp_matches(line, '^[\\s\\x0B]*$') GROUP BY 1")
def parse_errors(spark, sf_dir):
    """Lines that fit nothing, a thousand a file at most."""
    lines = documents_lens(spark, sf_dir).select("source_file", (F.col("doc_id") * 100_000 + F.col("line_number")).alias("line_number"), "line")
    bad = parse.parse_errors(lines, profile("iis-w3c"), AS_OF)
    return bad.groupBy("source_file", "reason").agg(F.count("*").alias("n"))


_TIERS = (
    "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "yyyy-MM-dd HH:mm:ss','SSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss +0000", "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yy','HH:mm:ss", "MMM d yyyy HH:mm:ss", "MMM d HH:mm:ss", "yyyyMMdd'T'HHmmss",
)


@query("""
SELECT id, CASE WHEN tier = 0 THEN date_trunc('second', timestamp) - INTERVAL 330 MINUTE WHEN tier = 1 THEN date_trunc('millisecond', timestamp)
  WHEN tier IN (6, 7) AND day(timestamp) <= 12 THEN date_trunc('second', timestamp) ELSE date_trunc('second', timestamp) END AS timestamp
FROM (SELECT *, (id % 11)::INT AS tier FROM e)""")
def sniff_tiers(spark, sf_dir):
    """Times found anywhere in a line, in eleven shapes."""
    lens = events_lens(spark, sf_dir)
    shape = F.coalesce(*[F.when(F.col("id") % len(_TIERS) == i, F.date_format("timestamp", f)) for i, f in enumerate(_TIERS)])
    return lens.select("id", parse.sniff_timestamp(F.concat(F.lit("event at "), shape, F.lit(" - done")), AS_OF).alias("timestamp"))


def _shaped(spark, sf_dir):
    """Each file writes its times in a shape of its own, every hundredth line in another, every seventh line has none."""
    lens = events_lens(spark, sf_dir)
    user = F.substring("source_file", 6, 1).cast("int")
    shape = F.when(F.col("id") % 100 == 0, 2).otherwise(user)
    stamp = F.coalesce(*[F.when(shape == i, F.date_format("timestamp", f)) for i, f in enumerate(_TIERS[:10])])
    return rendered(lens, F.when(F.col("id") % 7 == 0, F.concat(F.lit("no time in "), "component")).otherwise(F.concat(F.lit("event at "), stamp, F.lit(" - done"))))


_SHAPED = """SELECT line_number, CASE WHEN id % 7 = 0 THEN NULL WHEN tier = 0 THEN date_trunc('second', timestamp) - INTERVAL 330 MINUTE WHEN tier = 1 THEN date_trunc('millisecond', timestamp)
  ELSE date_trunc('second', timestamp) END AS timestamp
FROM (SELECT *, CASE WHEN id % 100 = 0 THEN 2 ELSE right(left(source_file, 6), 1)::INT END AS tier FROM e)"""


@query(_SHAPED)
def sniff_per_file(spark, sf_dir):
    """Files that keep to one shape: the tier that their first lines need is tried first."""
    lines = _shaped(spark, sf_dir)
    hints = parse.tier_hints(lines, AS_OF)
    return parse.parse_lines(lines, profile("plain-text"), AS_OF, hints).select("line_number", "timestamp")


@query(_SHAPED)
def sniff_without_hints(spark, sf_dir):
    """The same without hints: every line goes through the tiers in order."""
    return parse.parse_lines(_shaped(spark, sf_dir), profile("plain-text"), AS_OF).select("line_number", "timestamp")


@query("""
SELECT source_file AS path, CASE WHEN source_file IN ('user_0.log', 'user_5.log') THEN 'nginx-error' ELSE 'log4j-default' END AS profile_id, 1.0::DOUBLE AS detection_confidence
FROM e GROUP BY 1""")
def detect_formats(spark, sf_dir):
    """Two files in one format, eight in another."""
    lens = events_lens(spark, sf_dir)
    nginx = F.col("source_file").isin("user_0.log", "user_5.log")
    lines = rendered(lens, F.when(nginx, _RENDER["nginx-error"][0]()).otherwise(_known_levels()))
    order = F.row_number().over(analyse.Window.partitionBy("source_file").orderBy("line_number"))
    numbered = lines.where(F.col("line_number").isNotNull()).withColumn("line_number", order)
    return detect.detect_formats(numbered, lens.select(F.col("source_file").alias("path")).distinct(), builtin_profiles())


@query("SELECT severity, source_file, count(*) AS n FROM e GROUP BY 1, 2")
def parse_all(spark, sf_dir):
    """Files of two formats, each by its own profile."""
    lens = events_lens(spark, sf_dir)
    nginx = F.col("source_file").isin("user_0.log", "user_5.log")
    lines = rendered(lens, F.when(nginx, _RENDER["nginx-error"][0]()).otherwise(_RENDER["log4j-default"][0]()))
    found = lens.select(F.col("source_file").alias("path"), F.when(nginx, "nginx-error").otherwise("log4j-default").alias("profile_id")).distinct()
    return parse.parse_all(lines, found, builtin_profiles(), AS_OF).groupBy("severity", "source_file").agg(F.count("*").alias("n"))


@query("SELECT source_file, line_number, row_number() OVER (ORDER BY source_file, line_number) - 1 AS id FROM e")
def assign_ids(spark, sf_dir):
    return parse.assign_ids(events_lens(spark, sf_dir).drop("id")).select("source_file", "line_number", "id")


# --------------------------------------------------------------------------- filters
def _filter(name: str, spec: filters.FilterSpec, where: str, untimed: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.apply_filters(events_lens(spark, sf_dir, untimed), spec, AS_OF).select("id", "timestamp", "severity", "source_file", "message")

    query(f"SELECT id, timestamp, severity, source_file, message FROM {'u' if untimed else 'e'} WHERE {where}", name)(run)


_ANY = lambda test: " OR ".join(test.format(c=c) for c in ("message", "thread", "component"))
_T0, _T1 = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 6, 12, tzinfo=timezone.utc)
_filter("filter_severity", filters.FilterSpec.errors_only(), "severity IN ('Critical', 'Error')")
_filter("filter_problems", filters.FilterSpec.errors_and_warnings(), "severity IN ('Critical', 'Error', 'Warning')")
_filter("filter_at_least", filters.FilterSpec(at_least="Info"), "severity IN ('Critical', 'Error', 'Warning', 'Info')")
_filter("filter_time", filters.FilterSpec(start=_T0, end=_T1), "coalesce(timestamp, file_modified) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'", untimed=True)
_filter("filter_relative", filters.FilterSpec(last_seconds=86_400), "timestamp >= TIMESTAMP '2024-01-19'")
_filter("filter_untimed", filters.FilterSpec(hide_untimed=True), "timestamp IS NOT NULL", untimed=True)
_filter("filter_text", filters.FilterSpec(text="PURCHASE"), _ANY("contains(lower({c}), 'purchase')"))
_filter("filter_fuzzy", filters.FilterSpec(text="prhs", fuzzy=True), _ANY("regexp_matches({c}, '(?is)p.*?r.*?h.*?s')"))
_filter("filter_regex", filters.FilterSpec(regex=r"^(error|signup) .*[13]"), _ANY("regexp_matches({c}, '(?i)^(error|signup) .*[13]')"))
_filter("filter_exclude", filters.FilterSpec(exclude="click"), "NOT (" + _ANY("contains(lower({c}), 'click')") + ")")
_filter("filter_component", filters.FilterSpec(components=frozenset({"view", "error"})), "component IN ('view', 'error')")
_filter("filter_sources", filters.FilterSpec(sources=frozenset({"user_1.log", "user_3.log"})), "source_file IN ('user_1.log', 'user_3.log')")
_filter("filter_combined", filters.FilterSpec(severities=frozenset({"Error", "Warning"}), start=_T0, text="1", exclude="3", sources=frozenset({"user_1.log", "user_2.log"})), "severity IN ('Error', 'Warning') AND timestamp >= TIMESTAMP '2024-01-05' AND source_file IN ('user_1.log', 'user_2.log') AND (" + _ANY("contains({c}, '1')") + ") AND NOT (" + _ANY("contains({c}, '3')") + ")")
_TEXT = "(message || ' | ' || thread || ' | ' || component)"
_filter("multi_any", filters.FilterSpec(search=search.MultiSearch.parse("signup, 11")), f"regexp_matches({_TEXT}, 'signup|11')")
_filter("multi_all", filters.FilterSpec(search=search.MultiSearch.parse("error, 1, 2", mode="all")), f"contains({_TEXT}, 'error') AND contains({_TEXT}, '1') AND contains({_TEXT}, '2')")
_filter("multi_min", filters.FilterSpec(search=search.MultiSearch.parse("error, 1, 2", min_match=2)), f"contains({_TEXT}, 'error')::INT + contains({_TEXT}, '1')::INT + contains({_TEXT}, '2')::INT >= 2")
_filter("multi_not", filters.FilterSpec(search=search.MultiSearch.parse("-view, !click")), f"NOT regexp_matches({_TEXT}, 'view|click')")
_filter("multi_word", filters.FilterSpec(search=search.MultiSearch.parse("error, 12", whole_word=True)), f"regexp_matches({_TEXT}, '(?i)\\berror\\b|\\b12\\b')")


@query("SELECT source_file, count(*) AS n, 0::BIGINT AS hidden, count_if(source_file IN ('user_1.log', 'user_3.log') AND severity = 'Error') AS shown FROM e GROUP BY 1")
def filter_hidden(spark, sf_dir):
    """Of each file's entries, what passes with all files hidden, and with two of them chosen."""
    hidden = filters.FilterSpec(hide_all_sources=True).to_column()
    shown = filters.FilterSpec(sources=frozenset({"user_1.log", "user_3.log"}), severities=frozenset({"Error"})).to_column()
    return events_lens(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(hidden).alias("hidden"), F.count_if(shown).alias("shown"))


_MANY = ("error", "sign", "signup", "up", "view", "click", "1", "12", "3", "hase", "purchase", "0")
_FOUND = " + ".join(f"contains(lower({_TEXT}), '{t}')::INT" for t in _MANY)


@query(f"SELECT id, severity FROM e WHERE {_FOUND} >= 4")
def multi_one_scan(spark, sf_dir):
    """A number of many terms, some within others, found in one scan."""
    spec = filters.FilterSpec(search=search.MultiSearch.parse(", ".join(_MANY), min_match=4))
    return filters.apply_filters(events_lens(spark, sf_dir), spec).select("id", "severity")


@query(f"SELECT id, ({_FOUND})::BIGINT AS terms FROM e")
def multi_terms_found(spark, sf_dir):
    """How many of the terms each entry has."""
    terms = search.MultiSearch.parse(", ".join(_MANY))
    return events_lens(spark, sf_dir).select("id", F.size(terms.terms_in(F.concat_ws(" | ", "message", "thread", "component"))).cast("long").alias("terms"))


@query("SELECT id, severity FROM e WHERE id IN (SELECT id FROM e WHERE id % 97 = 0 AND severity = 'Error')")
def bookmarks_semi(spark, sf_dir):
    lens = events_lens(spark, sf_dir)
    marks = lens.where((F.col("id") % 97 == 0) & (F.col("severity") == "Error")).select("id", F.lit("look").alias("label"))
    return filters.apply_filters(lens, filters.FilterSpec(bookmarked=True), annotations=marks).select("id", "severity")


@query("""SELECT source_file, count(*) AS n FROM e WHERE source_file IN (
  SELECT source_file FROM e GROUP BY 1 HAVING max(timestamp) - INTERVAL (10 * right(left(source_file, 6), 1)::INT) DAY >= TIMESTAMP '2024-01-20' - INTERVAL 1200000 SECOND) GROUP BY 1""")
def activity_window(spark, sf_dir):
    """Entries of files that were changed within the window; files age by ten days a number here."""
    lens = events_lens(spark, sf_dir)
    files = lens.groupBy(F.col("source_file").alias("path")).agg(F.max("timestamp").alias("m")).select("path", (F.col("m") - F.make_dt_interval(10 * F.substring("path", 6, 1).cast("int"))).alias("modified"))
    return filters.apply_filters(lens, filters.FilterSpec(active_seconds=1_200_000), AS_OF, files=files).groupBy("source_file").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- aggregation and order
_DEDUP = """
SELECT source_file, arg_max(id, {order}) AS id, max(timestamp) AS timestamp, count(*) AS count, min(timestamp) AS first_timestamp, sum(id)::BIGINT AS ids
FROM {src} GROUP BY source_file, {key}"""
_ORDER = "(coalesce(epoch_us(timestamp), -1), id)"


def _deduped(entries: DataFrame, normalized: bool = False) -> DataFrame:
    return analyse.survivors(entries, normalized, {"ids": "id"}).select("source_file", "id", "timestamp", "count", "first_timestamp", "ids")


@query(_DEDUP.format(src="u", key="message", order=_ORDER))
def dedup_exact(spark, sf_dir):
    return _deduped(events_lens(spark, sf_dir, untimed=True))


@query(_DEDUP.format(src="u", key="regexp_replace(regexp_replace(message, '(?i)\\b0x[0-9a-f]{8,}\\b', '<HEX>', 'g'), '\\b\\d+(\\.\\d+)?\\b', '<NUM>', 'g')", order=_ORDER))
def dedup_normalized(spark, sf_dir):
    return _deduped(events_lens(spark, sf_dir, untimed=True), normalized=True)


@query("""
SELECT key, count(*) AS n FROM (
  SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line,
    '(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b', '<GUID>', 'g'),
    '(?i)\\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\\b|\\b(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}\\b|::1\\b', '<IP>', 'g'),
    '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}(:\\d+)?\\b', '<IP>', 'g'),
    '(?i)\\b0x[0-9a-f]{8,}\\b', '<HEX>', 'g'), '\\b\\d+(\\.\\d+)?\\b', '<NUM>', 'g') AS key
  FROM l WHERE regexp_matches(line, '^[\\x00-\\x7F]*$')) GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM l WHERE NOT regexp_matches(line, '^[\\x00-\\x7F]*$') HAVING count(*) > 0""")
def normalize_lines(spark, sf_dir):
    """Normalised lines of the documents.  SQL's word boundaries are those of ASCII, so lines with other characters are counted
    together; by name: :func:`normalize_all_lines`."""
    key = F.when(F.col("line").rlike(r"^[\x00-\x7F]*$"), normalize_message(F.col("line")))
    return documents_lens(spark, sf_dir).where("line is not null").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def _normalized(lines: DataFrame) -> DataFrame:
    return lines.groupBy(normalize_message(F.col("line")).alias("key")).agg(F.count("*").alias("n"))


@query()
def normalize_all_lines(spark, sf_dir):
    """Normalised lines of the documents, every one; without SQL, whose word boundaries and digits are those of ASCII."""
    return _normalized(documents_lens(spark, sf_dir))


@query("SELECT severity, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share FROM e GROUP BY 1")
def severity_breakdown(spark, sf_dir):
    """Rendered, parsed and broken down by severity."""
    lens = events_lens(spark, sf_dir)
    got = parse.parse_lines(rendered(lens, _RENDER["log4j-default"][0]()), profile("log4j-default"), AS_OF)
    return analyse.severity_breakdown(got)


@query("""SELECT severity, position::INT AS position, strftime(timestamp, '%H:%M:%S') AS clock, source_file AS file, message AS preview FROM (
  SELECT *, row_number() OVER (PARTITION BY severity ORDER BY timestamp, id) AS position FROM e) WHERE position <= 50""")
def severity_preview(spark, sf_dir):
    return analyse.severity_preview(events_lens(spark, sf_dir))


_SUMMARY = """SELECT source_file AS path, 'events' AS profile_id, count(*) AS entry_count, min(timestamp) AS earliest, max(timestamp) AS latest,
  count_if(severity = 'Error') AS error_count FROM e GROUP BY 1"""


def _summary(spark, sf_dir):
    lens = events_lens(spark, sf_dir)
    return analyse.file_summary(lens, lens.select(F.col("source_file").alias("path"), "profile_id").distinct(), lens.where(F.col("severity") == "Error").select("source_file"))


@query(_SUMMARY)
def file_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(f"SELECT count(*) AS files, count_if(entry_count > 0) AS files_with_entries, count_if(error_count > 0) AS files_with_errors, sum(entry_count)::BIGINT AS entries, sum(error_count)::BIGINT AS errors, min(earliest) AS earliest, max(latest) AS latest FROM ({_SUMMARY})")
def scan_summary(spark, sf_dir):
    return analyse.scan_summary(_summary(spark, sf_dir))


@query("SELECT DISTINCT component FROM e")
def components(spark, sf_dir):
    return analyse.distinct_components(events_lens(spark, sf_dir))


@query("SELECT count(*) AS total, count_if(severity = 'Error') AS matched, count_if(severity <> 'Error') AS hidden, count_if(timestamp IS NULL) AS untimed FROM u")
def counts(spark, sf_dir):
    return analyse.counts(events_lens(spark, sf_dir, untimed=True), F.col("severity") == "Error")


@query("SELECT id, timestamp, message FROM e ORDER BY timestamp, id LIMIT 1000")
def timeline_top(spark, sf_dir):
    return analyse.timeline(events_lens(spark, sf_dir), limit=1000).select("id", "timestamp", "message")


@query("SELECT id, timestamp, message FROM u ORDER BY timestamp DESC NULLS FIRST, id DESC LIMIT 2000")
def timeline_desc(spark, sf_dir):
    return analyse.timeline(events_lens(spark, sf_dir, untimed=True), newest_first=True, limit=2000).select("id", "timestamp", "message")


@query("SELECT id, timestamp, source_file FROM e WHERE epoch_us(timestamp) BETWEEN epoch_us(TIMESTAMP '2024-01-10') - 3600000000 AND epoch_us(TIMESTAMP '2024-01-10') + 3600000000")
def correlate_one(spark, sf_dir):
    return correlate.correlate(events_lens(spark, sf_dir), datetime(2024, 1, 10, tzinfo=timezone.utc), 3600).select("id", "timestamp", "source_file")


@query("SELECT a.id AS anchor_id, e.id FROM e a JOIN e ON e.timestamp BETWEEN a.timestamp - INTERVAL 30 SECOND AND a.timestamp + INTERVAL 30 SECOND WHERE a.severity = 'Error'")
def correlate_many(spark, sf_dir):
    """Every error with all entries within 30 seconds."""
    lens = events_lens(spark, sf_dir)
    return correlate.correlate_many(lens, lens.where(F.col("severity") == "Error")).select("anchor_id", "id")


@query("SELECT id, timestamp FROM e WHERE EXISTS (SELECT 1 FROM e a WHERE a.severity = 'Error' AND a.id % 9 = 0 AND e.timestamp BETWEEN a.timestamp - INTERVAL 45 SECOND AND a.timestamp + INTERVAL 45 SECOND)")
def correlate_any(spark, sf_dir):
    """Every entry near some error, once, without pairs."""
    lens = events_lens(spark, sf_dir)
    return correlate.correlate_any(lens, lens.where((F.col("severity") == "Error") & (F.col("id") % 9 == 0)), 45).select("id", "timestamp")


@query("""SELECT line_number, date_trunc('second', timestamp) AS timestamp, CASE severity WHEN 'Unknown' THEN 'Info' ELSE severity END AS severity, component, thread,
  'EventID ' || (id % 100) || ' | ' || component || ' | App | host | user=' || thread || ', kind=' || component AS message FROM e""")
def event_xml(spark, sf_dir):
    lens = events_lens(spark, sf_dir)
    level = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in {"Error": "2", "Warning": "3", "Info": "4", "Debug": "5"}.items()], F.lit("0"))
    xml = F.format_string(
        "<Event><System><Provider Name='%s'/><EventID>%s</EventID><Level>%s</Level><TimeCreated SystemTime='%sZ'/><EventRecordID>%s</EventRecordID><Execution ProcessID='%s' ThreadID='1'/><Channel>App</Channel><Computer>host</Computer></System>"
        "<EventData><Data Name='user'>%s</Data><Data Name='kind'>%s</Data></EventData></Event>",
        "component", (F.col("id") % 100).cast("string"), level, _stamp("yyyy-MM-dd'T'HH:mm:ss"), F.col("id").cast("string"), "thread", "thread", "component",
    )
    return read_event_xml(lens.select("source_file", xml.alias("xml"))).select("line_number", "timestamp", "severity", "component", "thread", "message")


_SAMPLED = """
s AS (SELECT CASE severity WHEN 'Error' THEN 'ERROR' WHEN 'Warning' THEN 'WARN' WHEN 'Info' THEN 'INFO' WHEN 'Debug' THEN 'DEBUG' ELSE 'NOTE' END AS word
  FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY id) AS n FROM e) WHERE n <= 50
    AND source_file IN (SELECT DISTINCT source_file FROM e ORDER BY 1 LIMIT 5) ORDER BY source_file, n LIMIT 50),
w AS (SELECT word, count(*) AS k FROM s GROUP BY 1),
t AS (SELECT max((k, 'N-N-N N:N:N,N ' || word)) AS t, max(k) AS k, sum(k) AS n, list(word) AS words FROM w)"""


@query(f""", {_SAMPLED}
SELECT 'user_.log' AS stem, 'user_*.log' AS glob, '%Y-%m-%d %H:%M:%S' AS timestamp_format, 1.0::DOUBLE AS timestamp_share,
  CASE WHEN k::DOUBLE / n >= 0.5 THEN t[2] END AS anchor, k::DOUBLE / n AS anchor_share,
  array_to_string(list_filter(['Error', 'Warning', 'Info', 'Debug'], lambda x: list_contains(words, CASE x WHEN 'Error' THEN 'ERROR' WHEN 'Warning' THEN 'WARN' WHEN 'Info' THEN 'INFO' ELSE 'DEBUG' END)), ',') AS levels
FROM t""")
def infer_profile(spark, sf_dir):
    """A proposal for files whose names differ in a digit."""
    lens = events_lens(spark, sf_dir)
    lines = rendered(lens, _RENDER["log4j-default"][0]())
    order = F.row_number().over(analyse.Window.partitionBy("source_file").orderBy("line_number"))
    return detect.infer_profile(lines.withColumn("line_number", order)).withColumn("levels", F.array_join("levels", ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import formats, stored  # noqa: F401  they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)

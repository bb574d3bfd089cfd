"""Event records from exported event XML, one string a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_space, decode_entities, severity_rank

MAX_PAIRS = 20


def _element(name: str) -> Column:
    value = F.regexp_extract("xml", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(collapse_space(decode_entities(value)), F.lit(""))


def _attribute(element: str, name: str) -> Column:
    return F.nullif(F.regexp_extract("xml", rf"<{element}\b[^>]*\b{name}=[\"']([^\"']*)[\"']", 1), F.lit(""))


def read_event_xml(records: DataFrame, profile_id: str = "event-xml") -> DataFrame:
    """Entries from ``records(source_file, xml)``.

    Level gives the severity, provider the component, process id (else thread id) the thread, record id the line; the message is
    the rendered one, else ``EventID n | provider | channel | computer | k=v, ...`` with 20 pairs at most.
    """
    level = _element("Level").try_cast("int")
    severity = F.when(level == 1, "Critical").when(level == 2, "Error").when(level == 3, "Warning").when(level.isin(0, 4), "Info").when(level == 5, "Debug").otherwise("Unknown")
    data = r"(?s)<Data(?:\s+Name=[\"']([^\"']*)[\"'])?\s*>(.*?)</Data>"
    names, values = F.regexp_extract_all("xml", F.lit(data), F.lit(1)), F.regexp_extract_all("xml", F.lit(data), F.lit(2))
    pair = lambda n, v: F.when(n == "", collapse_space(decode_entities(v))).otherwise(F.concat(n, F.lit("="), collapse_space(decode_entities(v))))
    pairs = F.zip_with(names, values, pair)
    user = F.regexp_extract("xml", r"(?s)<UserData>(.*?)</UserData>", 1)
    leaf = r"<(\w+)(?:\s[^>]*)?>([^<]+)</"
    user_pairs = F.zip_with(F.regexp_extract_all(user, F.lit(leaf), F.lit(1)), F.regexp_extract_all(user, F.lit(leaf), F.lit(2)), pair)
    shown = F.array_join(F.slice(F.when(F.size(pairs) > 0, pairs).otherwise(user_pairs), 1, MAX_PAIRS), ", ")
    provider = _attribute("Provider", "Name")
    fallback = F.concat_ws(" | ", F.concat(F.lit("EventID "), _element("EventID")), provider, _element("Channel"), _element("Computer"), F.nullif(shown, F.lit("")))
    created = F.regexp_replace(F.regexp_replace(_attribute("TimeCreated", "SystemTime"), r"(\.\d{6})\d+", "$1"), "Z$", "+00:00")
    message = F.coalesce(_element("Message"), fallback)
    return records.select(
        F.try_to_timestamp(created, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]xxx")).alias("timestamp"), severity.alias("severity"), severity_rank(severity).alias("severity_rank"),
        "source_file", _element("EventRecordID").try_cast("bigint").alias("line_number"), F.coalesce(_attribute("Execution", "ProcessID"), _attribute("Execution", "ThreadID")).alias("thread"),
        provider.alias("component"), message.alias("message"), F.col("xml").alias("raw_text"), F.lit(profile_id).alias("profile_id"),
    )

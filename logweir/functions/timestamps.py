"""Timestamps: a profile's format with its fallbacks, and tiers that find one anywhere in a line.

Everything is UTC (set ``spark.sql.session.timeZone`` to UTC).  The clock is always the argument ``as_of``.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPARK = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "e": "d", "H": "H", "k": "H", "I": "h", "l": "h", "M": "m", "S": "s", "b": "MMM", "B": "MMMM", "h": "MMM",
    "p": "a", "f": "SSSSSS", "z": "xx", "j": "D", "F": "yyyy-M-d", "T": "H:m:s", "R": "H:m", "D": "M/d/yy", "%": "%",
}
OFFSET = re.compile(r"(?<!%)(?:%%)*%(?::{0,3}z|#z)")


def spark_format(fmt: str) -> str:
    """strftime format -> Spark pattern; single letters accept one or two digits, ``%.f`` is an optional fraction."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            m = re.match(r"%(?:-|0|_)?(\.?\d?f|:{1,3}z|#z|[A-Za-z%])", fmt[i:])
            code = m[1] if m else fmt[i + 1]
            out += "[.SSSSSS]" if code.startswith(".") else "xxx" if ":" in code else "xx" if code in ("z", "#z") else _SPARK.get(code, "")
            i += len(m[0]) if m else 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
            i += 1
    return out


def has_offset(fmt: str) -> bool:
    return bool(OFFSET.search(fmt))


def has_year(fmt: str) -> bool:
    return bool(re.search(r"%[-0_]?[YyCFD]", fmt))


def _try(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


_ISO = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d{1,9})?(Z|z|[+-]\d{2}:\d{2})$"


def rfc3339_timestamp(text: Column) -> Column:
    """RFC 3339 with its offset applied; null for anything else."""
    part = lambda k: F.regexp_extract(text, _ISO, k)
    offset = F.when(F.upper(part(4)) == "Z", F.lit("+00:00")).otherwise(part(4))
    return F.when(text.rlike(_ISO), _try(F.concat(part(1), F.lit(" "), part(2), F.substring(part(3), 1, 7), offset), "yyyy-MM-dd HH:mm:ss[.SSSSSS]xxx"))


def parse_timestamp(text: Column, fmt: str, as_of: datetime) -> Column:
    """``text`` by a strftime format: the format itself, as a date, RFC 3339, with ``/`` and ``T`` as ``-`` and
    space, and with the year of ``as_of`` where the format has none."""
    raw = F.regexp_replace(F.trim(text), r"\s+", " ")
    if not fmt:
        return rfc3339_timestamp(raw)
    pattern = spark_format(fmt)
    steps = [_try(raw, pattern)] if has_year(fmt) else []
    steps.append(rfc3339_timestamp(raw))
    if has_year(fmt) and not has_offset(fmt):
        steps.append(_try(F.translate(raw, "/T", "- "), pattern))
    if not has_year(fmt):
        steps.append(_try(F.concat(F.lit(f"{as_of.year} "), raw), "yyyy " + pattern))
    return F.coalesce(*steps)


def _tiers(text: Column, as_of: datetime) -> list[Column]:
    """What each of 15 tiers finds, null where its pattern isn't there or doesn't parse.

    A tier's expression runs only on text that has the characters it can't do without, and only what it finds is parsed: a failed parse costs
    ten times a failed match.
    """
    get = lambda p, k=0: F.regexp_extract(text, p, k)
    clock = r"\d{2}:\d{2}:\d{2}"
    fraction = r"(?:\.\d{1,9})?"

    def having(marks: str, found: Column) -> Column:
        test = F.contains(text, F.lit(marks[0]))
        for m in marks[1:]:
            test &= F.contains(text, F.lit(m))
        return F.when(test, found)

    def plain(marks: str, pattern: str, fmt: str, change=lambda c: c, finer: bool = True) -> Column:
        hit = get(pattern)
        value = change(hit)
        return having(marks, F.when(hit != "", _try(F.regexp_replace(value, r"(\.\d{6})\d+", "$1") if finer else value, fmt)))

    def either_order(pattern: str, tail: str) -> Column:
        """Day/month order by the values: over 12 tells; else month first, then day first."""
        hit = get(pattern)
        value = F.replace(hit, F.lit(","), F.lit(" "))
        day, month = _try(value, "d/M/" + tail), _try(value, "M/d/" + tail)
        # A number over 12 is no month, so only one order parses.
        return having("/:", F.when(hit != "", F.coalesce(month, day)))

    zone = rf"(\d{{4}}-\d{{2}}-\d{{2}})[Tt ]({clock}(?:\.\d{{1,9}})?)(Z|[+-]\d{{2}}:?\d{{2}})"
    # The whole find in one form: a space, no more than six digits, an offset with a colon.
    found = F.regexp_replace(F.regexp_replace(get(zone), r"^(.{10})[Tt]", "$1 "), r"(\.\d{6})\d+", "$1")
    offset = F.regexp_replace(F.regexp_replace(found, "Z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    no_comma = lambda c: F.replace(c, F.lit(","), F.lit("."))
    month = lambda sep: lambda c: F.regexp_replace(c, sep, " ")
    seconds = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    return [
        having("-:", F.when(get(zone) != "", _try(offset, "yyyy-MM-dd HH:mm:ss[.SSSSSS]xxx"))),
        plain("-:,", rf"\d{{4}}-\d{{2}}-\d{{2}} {clock},\d{{1,9}}", "yyyy-MM-dd HH:mm:ss.SSSSSS", no_comma),
        plain("-:", rf"\d{{4}}-\d{{2}}-\d{{2}}[T ]{clock}{fraction}", seconds, lambda c: F.replace(c, F.lit("T"), F.lit(" "))),
        plain("/:", rf"\d{{4}}/\d{{2}}/\d{{2}} {clock}{fraction}", "yyyy/MM/dd HH:mm:ss[.SSSSSS]"),
        plain(".:", rf"\d{{2}}\.\d{{2}}\.\d{{4}} {clock}{fraction}", "dd.MM.yyyy HH:mm:ss[.SSSSSS]"),
        plain("/:", rf"\d{{2}}/[A-Za-z]{{3}}/\d{{4}}:{clock} [+-]\d{{4}}", "dd/MMM/yyyy:HH:mm:ss xx", finer=False),
        either_order(rf"(\d{{1,2}})/(\d{{1,2}})/\d{{4}} {clock}", "yyyy H:mm:ss"),
        either_order(rf"(\d{{1,2}})/(\d{{1,2}})/\d{{2}}[, ]{clock}", "yy H:mm:ss"),
        plain(":", rf"[A-Z][a-z]{{2}}\s+\d{{1,2}},?\s+\d{{4}}\s+{clock}", "MMM d yyyy HH:mm:ss", month(r",?\s+"), finer=False),
        plain(":", rf"[A-Z][a-z]{{2}}\s+\d{{1,2}}\s+{clock}", "yyyy MMM d HH:mm:ss", lambda c: F.concat(F.lit(f"{as_of.year} "), month(r"\s+")(c)), finer=False),
        plain("T", r"(?<!\d)\d{8}T\d{6}(?!\d)", "yyyyMMdd'T'HHmmss", finer=False),
        F.timestamp_seconds(get(r"^\d{10}").try_cast("bigint")),
        F.timestamp_millis(get(r"^\d{13}").try_cast("bigint")),
        plain(".", r"(?<!\d)\d{2}\.\d{2}\.\d{4}(?!\d)", "dd.MM.yyyy", finer=False),
        plain(":", rf"(?<!\d){clock}(?:[.,]\d{{1,9}})?", seconds, lambda c: F.concat(F.lit(f"{as_of:%Y-%m-%d} "), no_comma(c))),
    ]


def _apart(text: Column, found) -> Column:
    """``found(text)`` as the body of a lambda, which Spark evaluates as it stands.

    Generated code of all tiers is longer than what the JVM compiles (8000 bytes a method), and everything else in the same stage would be
    interpreted with it.
    """
    return F.get(F.transform(F.array(text), found), F.lit(0))


def sniff_timestamp(text: Column, as_of: datetime, tier: Column | None = None) -> Column:
    """The first of 15 tiers whose pattern is found and parses; ``tier`` (from :func:`sniffed_tier`, may be null) is tried before the others."""

    def found(t: Column) -> Column:
        tiers = _tiers(t, as_of)
        if tier is None:
            return F.coalesce(*tiers)
        likely = F.when(tier == 0, tiers[0])
        for i, one in enumerate(tiers[1:], 1):
            likely = likely.when(tier == i, one)
        return F.coalesce(likely, *tiers)

    return _apart(text, found)


def sniffed_tier(text: Column, as_of: datetime) -> Column:
    """Number (from 0) of the tier that :func:`sniff_timestamp` takes, null without one."""
    return _apart(text, lambda t: F.coalesce(*[F.when(one.isNotNull(), i) for i, one in enumerate(_tiers(t, as_of))]))

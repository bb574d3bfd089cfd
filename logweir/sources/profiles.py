"""Format profiles: the built-in catalogue, user files, validation."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .catalogue import PROFILES

MAX_PROFILES, MAX_FILE_BYTES, MAX_PATTERN = 100, 65_536, 4096
PLAIN_TEXT = "plain-text"
MODES = ("continuation", "skip", "raw")
GROUPS = ("timestamp", "level", "thread", "component", "message")
LEVELS = ("Critical", "Error", "Warning", "Info", "Debug")


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    content: str
    line: str
    format: str = ""
    mode: str = "continuation"
    files: tuple[str, ...] = ()
    levels: dict[str, list[str]] = field(default_factory=dict)
    overrides: dict[str, list[str]] = field(default_factory=dict)

    def group(self, name: str) -> int:
        """Number of a named group of ``line``, 0 if it has none."""
        return re.compile(_python(self.line)).groupindex.get(name, 0)


def _python(pattern: str) -> str:
    return re.sub(r"\(\?<(?![=!])", "(?P<", pattern)


def java_regex(pattern: str) -> str:
    """The expression for Spark: named groups as ``(?<x>``, ``.`` stops at ``\\n`` only, classes are Unicode.

    Case folding is Unicode too where the expression asks for it.
    """
    out = pattern.replace("(?P<", "(?<").replace("(?i)", "(?iu)")
    return "(?d)" + out


def problems(p: Profile, spark: SparkSession | None = None) -> list[str]:
    """Why a profile can't be used; empty if it can.  With a session its expressions are compiled by Spark too."""
    found = [f"{k} is empty" for k in ("id", "name", "content", "line") if not getattr(p, k).strip()]
    if p.mode not in MODES:
        found.append(f"unknown mode {p.mode}")
    found += [f"unknown severity {k}" for k in {*p.levels, *p.overrides} - {*LEVELS}]
    for pattern in (p.content, p.line, *(x for v in p.overrides.values() for x in v)):
        if len(pattern) > MAX_PATTERN:
            found.append(f"an expression is longer than {MAX_PATTERN}")
            continue
        try:
            re.compile(_python(pattern))
            if spark is not None:
                spark.range(1).select(F.lit("").rlike(java_regex(pattern))).collect()
        except Exception as e:
            found.append(f"{pattern[:60]} doesn't compile: {str(e)[:120]}")
    return found


def builtin_profiles() -> list[Profile]:
    return [Profile(**{k: tuple(v) if k == "files" else v for k, v in d.items()}) for d in PROFILES]


def profile_from_toml(text: str) -> Profile:
    """A user's profile: tables ``profile``, ``detection``, ``parsing``, ``severity_mapping``, ``severity_override``."""
    d = tomllib.loads(text)
    about, detection, parsing = (d.get(k, {}) for k in ("profile", "detection", "parsing"))
    words = lambda k: {name.capitalize(): list(v) for name, v in d.get(k, {}).items()}
    return Profile(
        id=about.get("id", ""), name=about.get("name", ""), content=detection.get("content_match", ""), files=tuple(detection.get("file_patterns", ())),
        line=parsing.get("line_pattern", ""), format=parsing.get("timestamp_format", ""), mode=parsing.get("multiline_mode", "continuation").lower(),
        levels=words("severity_mapping"), overrides=words("severity_override"),
    )


def register_profile(profiles: list[Profile], new: Profile) -> list[Profile]:
    """A profile with a known id takes its place; a new one goes to the end, :data:`MAX_PROFILES` in all."""
    if bad := problems(new):
        raise ValueError(f"{new.id}: {'; '.join(bad)}")
    if any(p.id == new.id for p in profiles):
        return [new if p.id == new.id else p for p in profiles]
    if len(profiles) >= MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    return [*profiles, new]


def load_profiles(folder: str | None = None) -> tuple[list[Profile], list[str]]:
    """Built-in and user profiles (``*.toml`` of ``folder``, by name), and a message for each that was skipped."""
    profiles, skipped = builtin_profiles(), []
    for path in sorted(Path(folder).glob("*.toml")) if folder else ():
        try:
            if path.stat().st_size > MAX_FILE_BYTES:
                raise ValueError(f"larger than {MAX_FILE_BYTES} bytes")
            profiles = register_profile(profiles, profile_from_toml(path.read_text()))
        except (ValueError, OSError, TypeError) as e:
            skipped.append(f"{path.name}: {e}")
    return profiles, skipped


def with_files(p: Profile, files: list[str]) -> Profile:
    return replace(p, files=tuple(files))

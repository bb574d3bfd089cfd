"""License scans: MinHash bands over overlapping text windows, then exact shingle containment; DataFrame functions only.

Words are runs of 0-9, a-z (A-Z lower-cased) and code points from U+0080: case and punctuation don't count.  Texts become
hashes of their ``SHINGLE``-word runs.  A template is cut into windows of ``WINDOW`` words at every word, a document into
windows at every ``STEP`` words and its last one.  A window's bands are its least shingle hash under each of ``BANDS`` seeds.  A
document window that shares a band with a window of a template retrieves that template.

The settings guarantee: a verbatim run of WINDOW + STEP - 1 words of a template holds a document window equal to one of the
template's, which is retrieved with certainty; windows of similarity j are with probability 1 - (1 - j)^BANDS each.  For
templates shorter than that every shingle is a band of its own, so any common shingle retrieves them.

Verification is exact: the number of a template's distinct shingles that the whole text has, ``CONTAINED`` of them at least.

A shared band needs a shared shingle, and a shared shingle its longest word: texts that have none of the templates' telling words
(:func:`telling_words`) are not cut into windows at all, which loses nothing.

The templates come in blocks of bounded size, each block's index is part of the plan, and a document is read,
cut, probed and verified in one projection: nothing is shuffled, no group is gathered.

Defined cases: null, empty and wordless texts match nothing and have an empty list; documents are judged row by row; templates
without words or name are ignored.  Input columns come back in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant_table, materialize

WINDOW, STEP, SHINGLE, BANDS, CONTAINED = 16, 8, 3, 4, 0.8
#: Templates of a block (its index is a constant of the plan, some kilobytes a template).
BLOCK_TEMPLATES = 64
MAX_WORDS = 20_000

# Opening lines and notices of common public licenses, as their projects publish them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def words_of(text: Column) -> Column:
    """Words, with empty strings where the text begins or ends with none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def with_shingles(df: DataFrame, k: int, near: list[str] | None = None) -> DataFrame:
    """Replace ``text`` by ``shingles``, the hashes of its runs of ``k`` words; fewer words make one run, none none.

    With ``near`` only texts that have one of those words are cut; the others have no shingles.
    ``words`` is a column of its own that is used more than once, so the optimizer keeps it out of the
    function that runs for every word.
    """
    rest = [c for c in df.columns if c != "text"]
    raw = df.select(*rest, words_of(F.col("text")).alias("raw"))
    worth = F.lit(True) if near is None else F.arrays_overlap("raw", F.split(F.lit(" ".join(near)), " "))
    none = F.array().cast("array<string>")
    words = raw.select(*rest, F.when(worth & (F.size("raw") > 0), F.filter("raw", lambda w: w != "")).otherwise(none).alias("words"))
    n = F.size("words")
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice("words", i, F.least(F.lit(k), n))))
    return words.select(*rest, F.when(n == 0, F.array().cast("array<long>")).when(n < k, F.array(F.xxhash64("words"))).otherwise(runs).alias("shingles"))


def telling_words(templates: DataFrame, k: int) -> list[str] | None:
    """The longest word of each run of ``k`` words: a text without any of them shares no shingle with a template.

    None beyond :data:`MAX_WORDS` (then every text is cut).
    """
    words = templates.select(F.filter(words_of(F.col("text")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    n = F.size("w")

    def longest(i: Column) -> Column:
        run = F.slice("w", i, F.least(F.lit(k), n))
        return F.array_max(F.transform(run, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]

    rows = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), longest)).alias("x")).distinct().limit(MAX_WORDS + 1).collect()
    return sorted(r.x for r in rows) if len(rows) <= MAX_WORDS else None


def with_bands(df: DataFrame, step: int, per: int, bands: int) -> DataFrame:
    """Add ``bands``: the bands of the windows of ``per`` shingles at every ``step`` and of the last one."""

    def seeded(b: int) -> Column:
        return F.transform("shingles", lambda h: F.xxhash64(h, F.lit(b)))

    def band(b: int) -> Column:
        own, n = F.col(f"seeded{b}"), F.size(f"seeded{b}")
        return F.transform("starts", lambda i: F.xxhash64(F.lit(b), F.array_min(F.slice(own, i, F.least(F.lit(per), n)))))

    last = F.greatest(F.size("shingles") - per + 1, F.lit(1))
    some, no_ints = F.size("shingles") > 0, F.array().cast("array<int>")
    starts = F.when(some, F.concat(F.sequence(F.lit(1), last, F.lit(step)), F.array(last))).otherwise(no_ints)
    wide = df.select("*", starts.alias("starts"), *[seeded(b).alias(f"seeded{b}") for b in range(bands)])
    return wide.select(*df.columns, F.flatten(F.array(*[band(b) for b in range(bands)])).alias("bands"))


def default_templates(spark: SparkSession) -> DataFrame:
    return constant_table(spark, list(TEMPLATES.items()), "license string, text string")


def _array(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")"


def _block(rows: list, per: int) -> tuple[Column, Column, Column]:
    """Constants of a block: all bands, band -> numbers of its templates, shingles of each template."""
    of: dict[int, set[int]] = {}
    for k, r in enumerate(rows):
        for band in r.bands:
            of.setdefault(band, set()).add(k)
    keys = sorted(of)
    known = F.expr(_array(keys))
    which = F.expr(f"map_from_arrays({_array(keys)}, array({', '.join('array(' + ', '.join(map(str, sorted(of[b]))) + ')' for b in keys)}))")
    need = F.expr("array(" + ", ".join(f"named_struct('license', {_quoted(r.license)}, 'shingles', {_array(sorted(set(r.shingles)))})" for r in rows) + ")")
    return known, which, need


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _retrieved(known: Column, which: Column) -> Column:
    """Numbers of the templates that share a band with the text."""
    hits = F.array_distinct(F.flatten(F.transform(F.array_intersect("bands", known), lambda b: which[b])))
    return F.when(F.size("bands") > 0, hits).otherwise(F.array().cast("array<int>"))


def _verified(numbers: Column, need: Column, contained: float) -> Column:
    def count(t: Column) -> Column:
        common = F.size(F.array_intersect(F.col("shingles"), t["shingles"]))
        return F.struct(t["license"].alias("license"), common.alias("common"), F.size(t["shingles"]).alias("need"))

    counted = F.transform(F.transform(numbers, lambda k: need[k]), count)
    return F.filter(counted, lambda m: m["common"] >= F.ceil(F.lit(contained) * m["need"]))


def scan(docs: DataFrame, templates: DataFrame | None = None, window: int = WINDOW, step: int = STEP, shingle: int = SHINGLE, bands: int = BANDS, contained: float = CONTAINED) -> DataFrame:
    """``row, matches`` for every row of ``docs(text, ...)``: ``matches`` is a list of (license, common, need), the shingles that the
    text has of a template and those that the template has; ``templates(license, text)``."""
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    per = window - shingle + 1  # shingles of a window
    n = F.size("shingles")
    cut = with_bands(with_shingles(templates.where("license is not null").select("license", "text"), shingle).where(n > 0), 1, per, bands)
    own = materialize(
        cut.select("license", "shingles", F.array_distinct(F.when(n >= per + step - 1, F.col("bands")).otherwise(F.col("shingles"))).alias("bands")), "templates"
    )
    blocks = max(1, -(-own.count() // BLOCK_TEMPLATES))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    near = telling_words(templates.where("license is not null"), shingle)
    out = with_bands(with_shingles(packed, shingle, near), step, per, bands)
    out = out.select("row", "shingles", F.concat("shingles", "bands").alias("bands"))
    found = []
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("license"), F.lit(blocks)) == block).orderBy("license").collect()
        if not rows:
            continue
        known, which, need = _block(rows, per)
        out = out.withColumn(f"hit{block}", _retrieved(known, which))
        found.append(_verified(F.col(f"hit{block}"), need, contained))
    empty = F.array().cast("array<struct<license:string,common:int,need:int>>")
    return out.select("row", F.array_sort(F.concat(empty, *found)).alias("matches"))

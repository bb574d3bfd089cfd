"""Collocations: phrases whose words stand together more often than their parts alone would have it.

Top-order marginalisation.  Every word opens one window of the longest phrase, as columns of the word and the words that lead it,
padded at the end of its piece; only those windows are counted.  A ROLLUP over the columns sums them into the counts of ever shorter
prefixes, which are the counts of all phrases, as every occurrence of a phrase is the beginning of one window.  Nothing is exploded per length.

A phrase occurs ``least`` times only if each shorter phrase in it does.  So two passes before find hashes of frequent phrases, the first of pairs,
the second of longer ones made of such, and a window ends where the phrase it would be isn't among them: what stands behind
belongs to no phrase in question.  Single words are counted all.  What the tasks keep of the frequent hashes is one bit each in a field of ``2 ** BITS``; phrases that share a bit only
admit more, so counts stay exact whatever the size of the input.

Tasks count the windows of their texts before Spark sees them, so a very frequent phrase is one row a task.

Defined cases: null and empty texts have no words; null languages are ``und``, together with those named so.  Repeated rows
count each.  Ties of a phrase's cuts go to the shortest first part, ties of phrases to the more frequent one and then to byte order.  Scores are
exact: products are decimals.  Very long texts are taken whole.  Only ``text`` and ``lang`` are read, so other columns can't clash.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_rows, materialize, mix64
from .tokens import slices

LONGEST, LEAST, MOST, SCALE = 4, 30, 2000, 2_000_000
#: Bits of the field of frequent hashes, and those by which hashes are dealt into parts (more with more partitions).
BITS, PART_BITS = 27, 11
#: Texts of a slice, in bytes; hashes that a task holds before it hands them on, and words and windows.
SLICE, HELD, KEPT = 2 << 20, 1 << 20, 300_000
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 16_384
UNKNOWN = "und"
#: Parts in which a language's best phrases are found before they meet.
SALT = 64

# Characters that end a piece; words end at spaces and tabs.
_END = b"\xff"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def words_and_ends(texts: list[str]) -> list[bytes]:
    """Words of texts in order, and :data:`_END` where a piece ends."""
    # No byte of UTF-8 is 0xFF; what is left of white space between words are spaces.
    data = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts)
    return data.translate(_TABLE).replace(_END, b" \xff ").split()


class _Numbers(dict):
    """Word -> its number; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Language:
    """Numbers and hashes of the words of one language that a task has met."""

    def __init__(self, name: str) -> None:
        self.seed = xxhash.xxh3_64_intdigest(name.encode())
        self.number = _Numbers({_END: 0})
        self.hashes = np.zeros(1, np.uint64)
        #: Windows so far: numbers of their words, and counts.
        self.windows: list[tuple[np.ndarray, np.ndarray]] = []

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words and ends of some texts, an end last, and the words' hashes."""
        words = words_and_ends(texts)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = islice(self.number, len(self.hashes), None)
        self.hashes = np.r_[self.hashes, np.array([xxhash.xxh3_64_intdigest(w, self.seed) for w in new], np.uint64)]
        ids = np.r_[ids, 0]
        return ids, self.hashes[ids]

    def held(self) -> int:
        """What is kept, in words and rows."""
        return len(self.number) + sum(len(n) for _, n in self.windows)


def phrase_keys(own: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the phrases of one, two, ... words that begin at each place, as far as they end within the words."""
    keys = [mix64(own)]
    with np.errstate(over="ignore"):
        for m in range(1, longest):
            keys.append(mix64(keys[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + own[m:]))
    return keys


def _within(field: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (field[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def possible(ids: np.ndarray, keys: list[np.ndarray], fields: list[np.ndarray | None], bits: int) -> list[np.ndarray]:
    """Of each length, the places where a phrase begins that lies in one piece, whose parts are possible, and whose hash is in its length's field."""
    out: list[np.ndarray] = []
    for key, field in zip(keys, fields):
        on = out[-1][:-1] & out[-1][1:] if out else ids > 0
        out.append(on & _within(field, key, bits) if field is not None else on)
    return out


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """Slices of a batch's texts, a language at a time."""
    langs, texts = batch.column("lang"), batch.column("text")
    for lang in langs.unique().to_pylist():
        own = texts.filter(pc.equal(langs, lang))
        for lo, hi in slices(own, SLICE):
            yield lang, own.slice(lo, hi - lo).to_pylist()


def _hash_counts(lengths: range, shared, least: int, bits: int, part_bits: int, most: int):
    """Hashes of the possible phrases of some lengths, with counts up to ``least``: by part, 32 bits each in order."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held) >> np.uint64(32 - part_bits), return_counts=True)
        n = np.minimum(n, least).astype("u1")
        part, first = np.unique((found >> np.uint64(32)).astype("i4"), return_index=True)
        low, ends = (found & np.uint64(0xFFFFFFFF)).astype("<u4"), np.r_[first[1:], len(found)]
        spans = list(zip(first.tolist(), ends.tolist()))
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array([low[a:b].tobytes() for a, b in spans]), pa.array([n[a:b].tobytes() for a, b in spans])], ["part", "low", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        fields = [f.value if f is not None else None for f in shared]
        known: dict[str, Language] = {}
        for b in batches:
            for lang, texts in _languages(b):
                if sum(x.held() for x in known.values()) > KEPT:
                    known = {}
                ids, own = known.setdefault(lang, Language(lang)).numbered(texts)
                keys = phrase_keys(own, lengths[-1])
                on = possible(ids, keys, fields, bits)
                held += [keys[m - 1][on[m - 1]] for m in lengths]
                if sum(map(len, held)) > most:
                    yield rows(held)
                    held = []
        if any(map(len, held)):
            yield rows(held)

    return run


def _frequent(least: int, bits: int, part_bits: int):
    """One part after the other, whose rows stand together: the field's bits of the hashes that are frequent in all."""

    def done(part: int, low: list[bytes], n: list[bytes]) -> pa.RecordBatch:
        found, inverse = np.unique(np.frombuffer(b"".join(low), "<u4"), return_inverse=True)
        often = found[np.bincount(inverse, np.frombuffer(b"".join(n), "u1")) >= least]
        own = np.zeros(1 << bits - part_bits, np.uint8)
        own[often >> np.uint32(32 - bits + part_bits)] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()])], ["part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, low, n = None, [], []
        for b in batches:
            for p, x, y in zip(b.column("part").to_pylist(), b.column("low").to_pylist(), b.column("n").to_pylist()):
                if p != part:
                    if part is not None:
                        yield done(part, low, n)
                    part, low, n = p, [], []
                low.append(x), n.append(y)
        if part is not None:
            yield done(part, low, n)

    return run


def frequent_field(texts: DataFrame, lengths: range, shared: list, least: int, bits: int = BITS):
    """A broadcast field of the hashes of phrases of ``lengths`` that occur ``least`` times in ``texts(lang, text)``.

    It has ``2 ** bits`` bits whatever the input; a part's counts are merged in one task, and parts grow in number with the partitions.
    """
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_bits = min(max(PART_BITS, (8 * n - 1).bit_length()), bits - 3)
    capped = min(least, 255)
    counted = texts.mapInArrow(_hash_counts(lengths, shared, capped, bits, part_bits, HELD), "part int, low binary, n binary")
    placed = counted.repartition(n, "part").sortWithinPartitions("part")
    field, each = np.zeros(1 << bits - 3, np.uint8), 1 << bits - part_bits - 3
    for r in bounded_rows(placed.mapInArrow(_frequent(capped, bits, part_bits), "part int, bits binary"), 1 << part_bits, "the field of frequent phrases"):
        field[r.part * each : (r.part + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(field)


def _windows(shared: list, longest: int, bits: int, most: int):
    """Distinct windows of a task's texts with their counts, as columns ``w1``, ``w2``, ..., padded with empty words."""
    columns = [f"w{i + 1}" for i in range(longest)]

    def rows(known: dict[str, Language]) -> Iterator[pa.RecordBatch]:
        for name, own in known.items():
            lead, n = merged(own.windows)
            words = pa.array([b"", *islice(own.number, 1, None)], pa.binary()).cast(pa.string(), safe=False)
            for at in range(0, len(n), OUT_ROWS):  # batches of a size that suits the reader
                some = lead[at : at + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), *(words.take(pa.array(c)) for c in some.T), pa.array(n[at : at + OUT_ROWS])], ["lang", *columns, "n"])
        known.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.value if f is not None else None for f in shared]
        known: dict[str, Language] = {}
        for b in batches:
            for lang, texts in _languages(b):
                if sum(x.held() for x in known.values()) > most:
                    yield from rows(known)
                language = known.setdefault(lang, Language(lang))
                ids, own = language.numbered(texts)
                at = np.flatnonzero(ids)
                # The lead columns: the i-th word is named where the phrase up to it is possible.
                lead = []
                for i, on in enumerate(possible(ids, phrase_keys(own, longest), fields, bits)):
                    goes = np.zeros(len(ids), bool)
                    goes[: len(on)] = on
                    lead.append(np.where(goes[at], ids[np.minimum(at + i, len(ids) - 1)], 0))
                language.windows.append(merged([(np.stack(lead, 1), np.ones(len(at), np.int64))]))
        yield from rows(known)

    return run


def merged(windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows once, with the sums of their counts."""
    lead, n = np.concatenate([w for w, _ in windows]), np.concatenate([k for _, k in windows])
    key, _ = _numbered_rows(list(lead.T))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return lead[first], np.bincount(inverse, n, len(first)).astype(np.int64)


def _numbered_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """A number for each row, the same for equal rows."""
    if len(columns) == 1:
        return columns[0], int(columns[0].max(initial=0)) + 1
    key, n = _numbered_rows(columns[:-1])
    last = columns[-1]
    wide = int(last.max(initial=0)) + 1
    joined = key * wide + last
    if n * wide < 1 << 31:
        return joined, n * wide
    found, inverse = np.unique(joined, return_inverse=True)
    return inverse, len(found)


def window_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """``lang, w1, ..., n``: the padded longest windows of ``docs(lang, text)`` and how often they occur, in part sums."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared: list = [None]
    for lengths in (range(2, min(3, longest + 1)), range(3, longest + 1)):
        if lengths:
            shared += [frequent_field(texts, lengths, [*shared, *[None] * len(lengths)], least, bits)] * len(lengths)
    words = ", ".join(f"w{i + 1} string" for i in range(longest))
    return texts.mapInArrow(_windows(shared, longest, bits, KEPT), f"lang string, {words}, n long")


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """``lang, words, f`` of the phrases of one to ``longest`` words that occur ``least`` times; and with no words, all word occurrences."""
    columns = [f"w{i + 1}" for i in range(longest)]
    windows = window_counts(docs, longest, least, bits)
    summed = windows.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))

    # A prefix's grouping bits are those of the columns behind it; padded ones are shorter prefixes, counted on their own.
    def level(k: int) -> Column:
        named = F.col(columns[k - 1]) != "" if k else F.lit(True)
        return (F.col("g") == (1 << longest - k) - 1) & named

    size = F.coalesce(*[F.when(level(k), k) for k in range(longest + 1)])
    words = F.slice(F.array(*columns), 1, F.greatest(F.col("size"), F.lit(0)))
    kept = summed.withColumn("size", size).where(F.col("size").isNotNull() & ((F.col("size") == 0) | (F.col("f") >= least)))
    return kept.select("lang", words.alias("words"), "f")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def score_phrases(counts: DataFrame) -> DataFrame:
    """``lang, words, phrase, a, l, r, score`` of the phrases of two words and more, each by its lowest-scoring cut."""
    known = counts.where(F.size("words") > 0).select("lang", _phrase(F.col("words")).alias("part"), "f")
    whole = counts.where(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"))
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("head", _phrase(F.slice("words", F.lit(1), F.col("k")))).withColumn("tail", _phrase(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))))
    part = lambda side, name: known.select("lang", F.col("part").alias(side), F.col("f").alias(name))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    # Products may pass 64 bits; the quotient of decimals is cut, not rounded.
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = scored.withColumn("score", score)
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    phrase = _phrase(F.col("words")).alias("phrase")
    return scored.groupBy("lang", "words", "a").agg(least).select("lang", "words", phrase, "a", "cut.l", "cut.r", "cut.score")


def drop_contained(scored: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Phrases without those whose occurrences lie, four fifths of them or more, in one longer phrase."""
    if longest < 3:
        return scored
    parts = [F.struct(F.lit(k).alias("at"), F.lit(n).alias("size")) for n in range(2, longest) for k in range(1, longest - n + 2)]
    inner = scored.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.array(*parts)).alias("p"))
    inner = inner.where((F.col("p.size") < F.size("words")) & (F.col("p.at") + F.col("p.size") - 1 <= F.size("words")))
    inside = inner.select("lang", _phrase(F.slice("words", F.col("p.at"), F.col("p.size"))).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return scored.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 80 * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``most`` phrases of two to ``longest`` words of ``docs(lang, text)``.

    ``a`` occurrences of the phrase, ``l`` and ``r`` of the parts of its worst cut, ``n`` words of the language.
    """
    counts = materialize(phrase_counts(docs, longest, least, bits), "phrases")
    total = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    kept = drop_contained(materialize(score_phrases(counts), "scored"), longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part first, so that no task gets all phrases of a language.
    part = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

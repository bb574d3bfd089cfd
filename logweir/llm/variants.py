"""Spelling variants: words that differ in one character, grouped under the most frequent form.

PartEnum signatures.  A word's letters are a binary vector with a dimension for each letter and how often it came before in the word.  One replaced
letter moves two dimensions, one inserted or deleted letter one.  Dimensions are dealt into ``PARTS`` parts; of two vectors
within distance two at least ``PARTS - 2`` parts are equal, so each choice of that many parts, with the word's length, is a
signature, and near words share one; words of lengths that differ by one share one of ``PARTS - 1`` parts.  Signatures meet by an
equality join and every meeting is verified on the words themselves, so a collision of hashes costs a comparison and no more.

A signature also holds one end of the word, the first or the last letters: one edit leaves one of the two ends as it is.  That
keeps words that merely consist of the same letters apart.

All of it is DataFrame expressions.  Words are counted map-side, so the text of a document is read once and only distinct words move.

Defined cases: null and empty texts have no words; a null ``doc_id`` counts as an empty one where slips are made; repeated rows count
each; very long texts and words are taken whole; of near words that are equally frequent the smaller one in code-point order is the form.
Only ``doc_id`` and ``text`` are read, so other columns can't clash.  An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The letters of a word; only A-Z are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a character.
SLIP = 199
LONG, OFTEN, RATIO, PARTS = 6, 5, 5, 4


def runs(docs: DataFrame, least: int) -> DataFrame:
    """``word`` for each run of letters in ``docs(doc_id, text)`` that has ``least`` characters, with the slips of the pen."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    found = found.where(F.length("run") >= least).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return found.select(F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def word_counts(docs: DataFrame, least: int = LONG, often: int = OFTEN) -> DataFrame:
    """``word, n`` of the words of ``least`` characters that occur ``often``."""
    return runs(docs, least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _parts(word: Column) -> Column:
    """The word's dimensions by part: ``PARTS`` strings of letters in order; equal letters are told apart by their number in the word."""
    letters = F.array_sort(F.split(word, ""))
    dealt = F.transform(letters, lambda c, i: F.struct(F.pmod(F.xxhash64(c, i - F.array_position(letters, c).cast("int")), F.lit(PARTS)).alias("part"), c.alias("c")))

    def part(k: int) -> Column:
        return F.array_join(F.transform(F.filter(dealt, lambda d: d["part"] == k), lambda d: d["c"]), "")

    return F.array(*[part(k) for k in range(PARTS)])


def signatures(words: DataFrame, least: int = LONG) -> DataFrame:
    """``sign, role, word`` for each signature of each of ``words(word)``.  Words of one length meet under role 0; a word meets those
    with one letter more as role 1, which are there as role 2."""
    end = least // 2
    size = F.length("word")
    w = words.select("word", size.alias("size"), _parts(F.col("word")).alias("parts"), F.substr("word", F.lit(1), F.lit(end)).alias("first"), F.right("word", F.lit(end)).alias("last"))
    signs = []
    for role, shorter, kept in ((0, 0, PARTS - 2), (1, 0, PARTS - 1), (2, 1, PARTS - 1)):
        for side in ("first", "last"):
            for chosen in combinations(range(PARTS), kept):
                which = F.lit(f"{side}{min(role, 1)}{chosen}")
                signs.append(F.struct(F.xxhash64(which, F.col("size") - shorter, side, *[F.get("parts", F.lit(k)) for k in chosen]).alias("sign"), F.lit(role).alias("role")))
    return w.select("word", F.inline(F.array(*signs))).select("sign", "role", "word")


def near_words(words: DataFrame, least: int = LONG) -> DataFrame:
    """``a, b``, both ways and once each: those of ``words(word)`` that differ by one inserted, deleted or replaced character.

    Every word has ``least`` characters or more.
    """
    signed = materialize(signatures(words, least), "signatures")
    left = signed.where("role < 2").select("sign", F.col("role").alias("ra"), F.col("word").alias("a"))
    right = signed.where("role <> 1").select("sign", F.col("role").alias("rb"), F.col("word").alias("b"))
    meets = ((F.col("ra") == 0) & (F.col("rb") == 0) & (F.col("a") < F.col("b"))) | ((F.col("ra") == 1) & (F.col("rb") == 2))
    # The cheap tests are part of the join; a pair that shares several signatures is kept once.
    met = left.join(right, "sign").where(meets & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()
    met = materialize(met, "near")
    return met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))


def follow_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for each row of ``forms(word, form)`` with a form: the last one reached.

    Pointers jump twice as far each round; a form is ``RATIO`` times as frequent as its word, so chains are short and don't close.
    """
    to = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = materialize(to.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        to = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return to


def spelling_variants(docs: DataFrame, least: int = LONG, often: int = OFTEN, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of ``docs(doc_id, text)``: occurrences, near words, the most frequent near word if
    it is ``ratio`` times as frequent, its occurrences, and the last form that is reached from word to word."""
    words = materialize(word_counts(docs, least, often), "words")
    near = near_words(words.select("word"), least).join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    right = -F.col("best.m") >= ratio * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(right, F.col("best.form")).alias("form"), F.when(right, -F.col("best.m")).alias("form_n"))
    formed = materialize(formed, "forms")
    return formed.join(follow_forms(formed), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

"""The registered queries of this subpackage: thin functions over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, minhash, mixing, phrases, pii, quality, token_counts, tokens, toxicity, urlfilter, variants, warc
from .sql import SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages")).select("row.page_id", "host", "path", "rule", "verdict")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).select(
        "row.doc_id", F.size("matches").alias("n_matches"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["common"].cast("string"))), ",").alias("licenses"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def held_out() -> Column:
    """Rows that a model never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "row.doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    ).withColumn("held_out", held_out())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii.entities(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", *map(of, pii.KINDS[:4]), F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans")
    )


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op6_pii`` that SQL can express: the base entities."""
    return op6_pii(spark, sf_dir).drop("spans")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), carry=["doc_id"]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op9_quality`` that SQL can express: the counts and the rules on them."""
    return op9_quality(spark, sf_dir).drop("kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position", "ranks")


#: A document with more tokens doesn't fit into a training window.
TOKEN_LIMIT = 1024


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.store_counts(_read(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_read(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pii_base": pii_base, "quality_base": quality_base}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

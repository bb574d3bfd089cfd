"""Corpus pipeline: documents -> token shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's documents.  All stages but the last return the columns of ``documents``.

Nulls in any column, empty and very long texts, repeated rows and columns with clashing names pass as each stage says; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweir.llm import decontaminate, minhash, mixing, tokens, toxicity
from logweir.llm.common import materialize, new_dir, running_totals
from logweir.llm.queries import held_out, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; rows with and without labels alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where(F.col("score") < 0.5).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, and one of rows equal in id and text (that with
    the least hash of all columns, if others differ).

    Rows that share an id but not a text are compared by their texts: of those that are near-duplicates of each other or of a
    kept document one stays.  Documents with a null id aren't compared; of those with equal texts one stays.
    """
    found = minhash.near_duplicates(docs)
    # A component's smallest id may have several texts in it: the one with the smallest mark stays.
    groups = found.where("kept").groupBy(F.coalesce("component", "mark").alias("group"), "mark").agg(F.count("*").alias("n"))
    kept = materialize(groups.groupBy("group").agg(F.min(F.struct("mark", "n")).alias("m")).select("m.mark", "m.n"), "kept")
    marked = docs.withColumn("__mark", minhash.mark_of(docs))
    single = marked.join(kept.where("n = 1").select(F.col("mark").alias("__mark")), "__mark", "left_semi").select(*docs.columns)
    # Repeated rows are few or shrink before the shuffle.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = marked.join(kept.where("n > 1").select(F.col("mark").alias("__mark")), "__mark", "left_semi")
    one = repeated.groupBy("__mark").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return single.unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("starts") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in training order (:func:`..mixing.occurrences`, which states the cases)."""
    return mixing.occurrences(docs)


def training_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``, 0 for the first row: the order of its files and of the rows in them.

    Tables that don't come from files have no order of their own; theirs is that of id and text.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return running_totals(docs, [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")], {"position": F.lit(1)})
    part = F.regexp_extract("__file", r"part-(\d+)", 1).try_cast("long")
    files = placed.groupBy("__file").agg(F.count("*").alias("n")).withColumn("part", part)
    before = files.select(F.col("__file"), (F.sum("n").over(Window.orderBy("part", "__file")) - F.col("n")).alias("before"))  # a row a file
    return placed.join(before, "__file").select(*docs.columns, (F.col("before") + F.col("__row")).alias("position"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, with an index by training position, read back:
    ``doc_id, position, start, n_tokens, ids_crc32`` for every row.

    Each time a document was taken is a row with a position, and a key of the index, of its own.  Null and empty texts are the end
    id alone; null ids stay null; an empty table gives none.
    """
    placed = training_order(docs.select("doc_id", "text"))
    stored = tokens.round_trip(placed.select(F.col("position").alias("doc_id"), "text"), tokenizer_path(), distinct=True)
    stored = stored.select(F.col("doc_id").alias("position"), "start", "n_tokens", "ids_crc32")
    return placed.select("doc_id", "position").join(stored, "position").select("doc_id", "position", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can't express the trained toxicity stage; tests/llm/test_llm_queries.py holds every other stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

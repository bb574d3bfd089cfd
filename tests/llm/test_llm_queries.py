"""Registered queries against DuckDB, and the pipeline's stages, on the smallest tables."""

import hashlib
import os
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import same
from logweir.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_all_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == before.columns
        if i < 3:
            assert docs.join(before, "doc_id", "left_anti").count() == 0 and docs.count() == docs.select("doc_id").distinct().count()
        if name == "decontaminate":
            from logweir.llm import decontaminate

            assert decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where(F.size("starts") > 0).count() == 0
    mixed = spark.read.parquet(str(tmp_path / "3"))
    order = [r.doc_id for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    last = docs.orderBy("start").collect()
    assert [r.doc_id for r in last] == order and [r.position for r in last] == list(range(len(order)))
    assert docs.count() == mixed.count() and docs.agg(F.sum("n_tokens")).first()[0] == docs.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Duplicates by row, contamination, choice of the mix and tokens of odd rows: nulls, repeats, clashing columns."""
    import corpus_pipeline
    from test_llm_small import brute_choice, brute_components
    from tokenizers import Tokenizer

    rng = random.Random(20)
    text = lambda n: " ".join("w%d" % rng.randrange(300) for _ in range(n))
    long, item = text(60), text(12)
    rows = [(i, text(rng.randrange(1, 60)), "abc"[i % 3]) for i in range(60)] + [(100, long, "a"), (101, long + " tail", "b"), (2, long, "c"), (102, text(20) + " " + item + " " + text(5), "a")]
    rows += [rows[5]] * 4 + [(None, "no id here", None), (None, "no id here", None), (200, None, "a"), (201, "", "b"), (7, text(30), "c")]
    df = spark.createDataFrame([(*r, "mark", 1) for r in rows], "doc_id long, text string, source string, mark string, position int")
    stage = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        stage[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = step("minhash", df)
    # Each (id, text) as a document of its own, smallest id and then smallest mark first.
    marks = sorted({(i, t) for i, t, _ in rows if i is not None}, key=lambda r: (r[0], hashlib.md5(f"{r[0]}:{r[1] or ''}".encode()).hexdigest()))
    groups = brute_components(list(enumerate(t for _, t in marks)))
    want = [marks[k] for k in groups if groups[k][1] == k] + [(None, "no id here")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str) and kept.columns == df.columns
    clean = step("decontaminate", kept)
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, _ in want if i != 102), key=str)
    mixed = step("mixing", clean)
    taken = {}
    for r in mixed.collect():
        taken[r.source, hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()] = 0
    own = [("" if r.doc_id is None else r.doc_id, r.text, r.source) for r in clean.collect()]
    choice = brute_choice(own)
    assert taken.keys() == {k for k, n in choice.items() if n} and mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(choice.values())
    order = mixed.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    last = step("tokens", mixed).orderBy("position").collect()
    t, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    for r, d in zip(last, order, strict=True):
        ids = t.encode(d.text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for name in ("minhash", "decontaminate", "mixing", "tokens"):
        assert stage[name](spark, df.limit(0), str(tmp_path)).count() == 0

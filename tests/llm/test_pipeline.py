"""Each stage of the pipeline on its own input, and the whole, by what must hold of the rows."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import language, linededup, mixing, neardup
from lexmill.llm.common import BATCH_ROWS
from lexmill.llm.queries import pieces_model

DIR = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(10_001, None, "en", "a", None), (10_002, "", None, "a", 0), (10_003, " \n12", "en", None, 4), (None, "Some words of an English text without an id, and more of them.", "en", "b", 65)]
    return rows.unionByName(spark.createDataFrame(odd, rows.schema)).withColumns({"row": F.lit("x"), "class_id": F.lit(7)}).cache()


def test_language_stage(spark, docs):
    kept = STAGES["language_id"](spark, docs, DIR)
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()
    gone = docs.exceptAll(kept).collect()
    assert {10_001, 10_002, 10_003} <= {r["doc_id"] for r in gone}
    model = language.train(docs)
    assert all((p := model.predict(r["text"]))[0] == "und" or p[1] < corpus_pipeline.LEAST_SCORE for r in gone)
    assert len(gone) < 0.2 * docs.count()


def test_line_stage(spark, docs):
    left = STAGES["line_dedup"](spark, docs, DIR)
    assert left.columns == docs.columns
    lines = left.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(linededup.eligible(F.col("line")))
    assert lines.groupBy("line").count().where("count > 1").isEmpty()
    assert left.where("n_chars != length(text)").isEmpty()
    # every line that there was is still there once, or one near it is
    before = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(linededup.eligible(F.col("line"))).distinct()
    missing = [r["line"] for r in before.join(lines, "line", "left_anti").collect()]
    kept = [r["line"] for r in lines.collect()]
    assert all(any(abs(len(m) - len(k)) <= linededup.EDITS and sum((Counter(m) - Counter(k)).values()) <= linededup.EDITS for k in kept) for m in missing)


def test_near_duplicate_stage(spark, docs):
    kept = STAGES["minhash_near_dedup"](spark, docs, DIR)
    classes = neardup.near_duplicates(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()
    assert kept.count() == classes.select("class_id").distinct().count()


def test_near_duplicate_stage_exchanges_rows_once(spark, docs, tmp_path):
    """Whole rows are as large as the input; exchanged once for the join and again for repeats, they took the stage over its disk."""
    docs = docs.drop("row")
    docs.unionByName(docs.where("doc_id is null or doc_id < 50")).write.parquet(f"{tmp_path}/twice")
    kept = STAGES["minhash_near_dedup"](spark, spark.read.parquet(f"{tmp_path}/twice"), DIR)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = spark._jvm.PythonSQLUtils.explainString(kept.select("*")._jdf.queryExecution(), "formatted")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    inputs = re.findall(r"\) Exchange *\nInput[^\n]*", plan)
    assert sum(bool(re.search(r"\b(row|first)#", x)) for x in inputs) == 1
    assert kept.exceptAll(docs).isEmpty() and kept.count() == neardup.near_duplicates(docs).select("class_id").distinct().count()


def test_mixing_stage(spark, docs):
    mixed = STAGES["source_mixing"](spark, docs, DIR)
    assert mixed.columns == docs.columns and mixed.distinct().exceptAll(docs.distinct()).isEmpty()
    assert mixed.where("doc_id is not null").groupBy("doc_id", "text").count().where("count > 2").isEmpty()
    target = {r["source"]: r["target"] for r in mixing.mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id").collect()}
    size = mixed.groupBy("source").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).alias("n"), F.max(F.coalesce(F.length("text"), F.lit(0))).alias("most"))
    assert all(abs(r["n"] - target[r["source"]]) <= r["most"] for r in size.collect() if r["source"] in target)


def test_piece_stage(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces_model())
    got = {r["doc_id"]: r["n_tokens"] for r in STAGES["sentencepiece"](spark, docs, DIR).collect()}
    assert all(got[r["doc_id"]] == len(library.encode(r["text"] or "")) for r in docs.collect())


@pytest.mark.parametrize("name", ["language_id", "minhash_near_dedup", "sentencepiece"])
def test_python_stages_take_few_rows_at_a_time(spark, docs, name):
    """A stage that is given its rows bounds the batches itself; with Spark's 10,000 rows they took over 3000 MB of an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        STAGES[name](spark, docs.limit(3), DIR)
        assert int(spark.conf.get(key)) == BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def test_shingles_need_little_memory():
    """Whatever a batch holds: equal to those of each text by itself, with far less memory at its peak than all texts at once."""
    texts = [" ".join(f"w{(i * j) % 977}" for j in range(800)) for i in range(2_000)] + [None, ""]
    idf = np.ones(neardup.BUCKETS, np.float32)
    tracemalloc.start()
    text, s, count = neardup.shingles(texts)
    peak = tracemalloc.get_traced_memory()[1] - 2 * (text.nbytes + s.nbytes + count.nbytes)
    tracemalloc.stop()
    assert peak < 60 * neardup.CUT_CHARS
    for i in (0, 1, 997, 1_999, 2_000):
        own = neardup.shingles([texts[i]])
        assert (s[text == i] == own[1]).all() and (count[text == i] == own[2]).all() and (text == i).sum() == len(own[1])
    assert (neardup.signatures(texts[990:1010], idf)[7] == neardup.signatures([texts[997]], idf)[0]).all()


def test_the_whole(spark, tmp_path):
    got = corpus_pipeline.run(spark, DIR)
    ids = Counter(r["doc_id"] for r in got.collect())
    known = {r["doc_id"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()}
    assert 0 < len(ids) <= len(known) and set(ids) <= known and max(ids.values()) <= 2
    spark.read.parquet(f"{DIR}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""A pipeline over documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import language, linededup, mixing, neardup, sentencepieces
from lexmill.llm.common import checkpoint_dir, few_rows, table
from lexmill.llm.queries import pieces_model

#: Documents whose language is less sure than this go.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from them; those without letters, and those that are like no language, go."""
    few_rows(spark)
    found = docs.select(F.struct("*").alias("row"), language.language_column(F.col("text"), language.train(docs)).alias("found"))
    return found.where(f"found.lang != '{language.UNKNOWN}' and found.score >= {LEAST_SCORE}").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line of any document go, and documents that had no other words."""
    return linededup.without_repeated_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take part by their target weights: some documents go, some come twice."""
    return mixing.mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document of the mix."""
    few_rows(spark)
    return sentencepieces.encode_documents(docs, pieces_model())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: The stages have models, samples and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, over documents; what each returns is written in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    where = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
    return docs

"""Reading landed documents: lines of text, link tables, plans; and writing with a check of what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): a text cut at line breaks. A null text has no lines."""
    return docs.select(key, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line_no", "line"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, UTF-8 with or without a mark, or else Windows-1252."""

    @F.pandas_udf("string")
    def windows(data):  # noqa: ANN001, ANN202
        return data.map(lambda b: bytes(b).decode("cp1252", "replace"))

    raw = spark.read.format("binaryFile").load(path)
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
    return raw.select("path", F.coalesce(utf8, windows("content")).alias("text"))


def link_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a tab-separated table with # comments; of a key that is given again, the last line counts."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("p"), "value", F.monotonically_increasing_id().alias("i"))
    rows = raw.where(~F.col("value").startswith("#") & (F.size("p") >= 2)).select(F.trim(F.col("p")[0]).alias("key"), F.trim(F.col("p")[1]).alias("value"), "i")
    return rows.groupBy("key").agg(F.max_by("value", "i").alias("value"))


def plan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Operations of a plan in JSON; fields that the schema does not have are ignored."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_checked(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """Writes beside the target, reads that back, compares both as bags, and only then moves it; the target must not exist."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path}.{uuid.uuid4().hex}"
    rows.write.format(format).save(staged)
    back = spark.read.schema(rows.schema).format(format).load(staged)
    if not rows.exceptAll(back).isEmpty() or not back.exceptAll(rows).isEmpty():
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
        raise OSError(f"what was written to {path} differs from what was given")
    fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target)


def report_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, sep=";", header=True)

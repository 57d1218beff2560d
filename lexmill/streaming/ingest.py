"""Incremental ingestion of landed documents: each different text once, with its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def new_documents(spark: SparkSession, path: str, schema: str, late: str = "1 day") -> DataFrame:
    """Documents from a folder of Parquet files, known by the digest of their text; copies within the watermark are left out."""
    rows = spark.readStream.schema(schema).parquet(path)
    rows = rows.withColumns({"digest": F.sha2(F.col("text").cast("binary"), 256), "seen_at": F.current_timestamp()})
    return rows.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["digest"])


def ingest(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to the target and ends; a rerun goes on where the last one stopped."""
    return docs.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)

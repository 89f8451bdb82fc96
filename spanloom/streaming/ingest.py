"""Incremental ingestion: documents as they arrive, once each, and windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def stream_parquet(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def dedup_stream(docs: DataFrame, at: str = "ts", late: str = "1 day", text_col: str = "text") -> DataFrame:
    """The first arrival of each text; its state goes when the watermark has passed."""
    return docs.withColumn("text_key", F.sha2(F.encode(text_col, "utf-8"), 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["text_key"])


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """What has arrived since the last run; the checkpoint makes reruns exactly-once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

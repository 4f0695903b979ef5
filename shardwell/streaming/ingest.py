"""Incremental ingest, an addition of ours: new files become chunks, each content once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardwell.functions.text import chunk_id, token_estimate


def chunk_stream(docs: DataFrame, content: str = "text", time: str = "arrived", late: str = "1 hour") -> DataFrame:
    """chunk_id and tokens of streamed rows; a content that comes again within the watermark is dropped."""
    rows = docs.withColumn("chunk_id", chunk_id(F.col(content))).withColumn("tokens", token_estimate(F.col(content)))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["chunk_id"])


def usage_stream(events: DataFrame, time: str = "ts", key: str = "user_id", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Uses by key and window; a window closes when the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("uses"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

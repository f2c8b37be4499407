"""The debug event log as a stream: NDJSON lines in, counts per event type and time window out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sessionId string, runId string, hypothesisId string, location string, message string, data string, timestamp long"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines appended under ``path``; the time is the epoch in milliseconds."""
    return spark.readStream.schema(SCHEMA).json(path).withColumn("ts", F.timestamp_millis("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events per run, message and window; those later than ``late`` are dropped, so the state is bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "runId", "message").agg(F.count(F.lit(1)).alias("n"))


def append_lines(events: DataFrame, path: str, checkpoint: str):
    """Start writing events as NDJSON, each once."""
    return events.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").start(path)

"""Recorded turns as a stream: repeated records dropped within a watermark, turns counted per thread and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_turns(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of trace files (JSON lines) as they appear."""
    return spark.readStream.schema(schema).json(folder)


def distinct_turns(turns: DataFrame, late: str = "1 day") -> DataFrame:
    return turns.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["trace_id"])


def distinct_turns_batch(turns: DataFrame) -> DataFrame:
    """The same over recorded files that are all there."""
    return turns.dropDuplicates(["trace_id"])


def turns_per_thread(turns: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window, thread_id, turns, latency) per window of event time; on a stream the watermark is that of ``distinct_turns``."""
    return turns.groupBy(F.window("logged_at", width), "thread_id").agg(F.count(F.lit(1)).alias("turns"), F.avg("latency_ms").alias("latency"))

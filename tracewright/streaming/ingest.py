"""Traces as a stream: new trace files are read as they come, statistics follow in event-time windows.

A file that the store writes anew, since another trace in it was replaced or pruned, brings its traces again; where that
happens, drop repeated trace ids within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.schemas import BUILDS, SPANS


def builds_stream(spark: SparkSession, root: str, files_per_trigger: int = 1_000) -> DataFrame:
    return _stream(spark, f"{root}/builds", BUILDS, files_per_trigger)


def spans_stream(spark: SparkSession, root: str, files_per_trigger: int = 1_000) -> DataFrame:
    return _stream(spark, f"{root}/spans", SPANS, files_per_trigger)


def _stream(spark: SparkSession, path: str, schema, files: int) -> DataFrame:
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("start_time", F.timestamp_millis("start_time_unix_millis"))


def windowed_stats(builds: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window of start times: builds, failures, hits, targets and total duration. Later builds than ``late`` are
    left out by the watermark, which also bounds the state."""
    grouped = builds.withWatermark("start_time", late).groupBy(F.window("start_time", window))
    counts = grouped.agg(F.count("*").alias("builds"), F.sum("failure_count").alias("failures"), F.sum("cache_hit_count").alias("hits"), F.sum("total_targets").alias("targets"), F.sum("total_duration_millis").alias("duration_millis"))
    return counts.select(F.col("window.start").alias("from"), F.col("window.end").alias("until"), "builds", "failures", "hits", "targets", "duration_millis")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished windows once, as Parquet; ends when all files so far are read."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

"""Everyday questions over traces, as users ask them of exported tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import date_of, short_commit, short_id
from tracewright.operators.traces import io_ms_stats

DAY = 86_400_000


def recent_builds(builds: DataFrame, n: int = 10) -> DataFrame:
    top = builds.orderBy(F.col("start_time_unix_millis").desc(), "trace_id").limit(n)
    return top.select(short_id(F.col("trace_id")).alias("trace"), "command", (F.col("total_duration_millis") / 1000.0).alias("seconds"), "total_targets", "cache_hit_count", short_commit(F.col("git_commit")).alias("commit"))


def slowest_misses(spans: DataFrame, n: int = 10, more_than: int = 3) -> DataFrame:
    rows = spans.where("cache_result = 'CACHE_MISS'").groupBy("label").agg(F.count("*").alias("runs"), F.avg("total_duration_millis").alias("avg_millis"), F.avg("command_duration_millis").alias("avg_command_millis"))
    return rows.where(F.col("runs") > more_than).orderBy(F.col("avg_millis").desc(), "label").limit(n)


def daily_hit_rate(builds: DataFrame, days: int = 14) -> DataFrame:
    rows = builds.groupBy(date_of(F.col("start_time_unix_millis")).alias("day")).agg(F.count("*").alias("builds"), (F.sum("cache_hit_count") * F.lit(100.0).cast("double") / F.nullif(F.sum("total_targets"), F.lit(0).cast("long"))).alias("hit_rate"))
    return rows.orderBy(F.col("day").desc()).limit(days)


def by_io(spans: DataFrame, n: int = 10) -> DataFrame:
    rows = spans.groupBy("label").agg(F.avg("output_write_millis").alias("avg_write"), F.avg("output_load_millis").alias("avg_load"), F.avg(io_ms_stats()).alias("avg_io"))
    return rows.orderBy(F.col("avg_io").desc(), "label").limit(n)


def typed(builds: DataFrame) -> DataFrame:
    """Builds with a timestamp."""
    return builds.withColumn("start_time", F.timestamp_millis("start_time_unix_millis"))


def daily_durations(builds: DataFrame) -> DataFrame:
    return builds.groupBy(date_of(F.col("start_time_unix_millis")).alias("day")).agg(F.avg("total_duration_millis").alias("avg_millis"), F.max("total_duration_millis").alias("max_millis"), F.count("*").alias("builds"))


def ci_hit_rate(builds: DataFrame, until: int, days: int = 14) -> DataFrame:
    """Mean of the builds' own rates, by day; unlike the ratio of sums, small builds count as much as large ones."""
    rows = builds.where(F.col("is_ci") & (F.col("start_time_unix_millis") >= until - days * DAY) & (F.col("total_targets") > 0))
    # Rates in millionths, so that a sum has one value.
    rate = F.floor(F.col("cache_hit_count").cast("long") * 100_000_000 / F.col("total_targets")).cast("long")
    return rows.groupBy(date_of(F.col("start_time_unix_millis")).alias("day")).agg((F.avg(rate) / 1_000_000).alias("avg_hit_rate"), F.count("*").alias("builds"))


def per_day_and_command(builds: DataFrame, until: int, days: int = 30) -> DataFrame:
    rows = builds.where(F.col("start_time_unix_millis") >= until - days * DAY)
    ratio = F.try_divide(F.sum("cache_hit_count") * F.lit(100.0).cast("double"), F.sum("total_targets"))
    return rows.groupBy(date_of(F.col("start_time_unix_millis")).alias("day"), "command").agg(F.count("*").alias("builds"), F.avg("total_duration_millis").alias("avg_millis"), ratio.alias("hit_rate"))


def unnested(traces: DataFrame, more_than: int = 5) -> DataFrame:
    """Nested traces -> measures per label."""
    rows = traces.select(F.explode("spans").alias("s")).groupBy("s.label").agg(
        F.count("*").alias("runs"), F.avg("s.total_duration_millis").alias("avg_millis"), F.count_if(F.col("s.cache_result") == "CACHE_MISS").alias("misses")
    )
    return rows.where(F.col("runs") > more_than)


def slowest_builds(builds: DataFrame, n: int = 5) -> DataFrame:
    return builds.orderBy(F.col("total_duration_millis").desc(), "trace_id").limit(n).select("trace_id", "total_duration_millis")


def miss_counts(spans: DataFrame) -> DataFrame:
    return spans.where("cache_result = 'CACHE_MISS'").groupBy("label").agg(F.count("*").alias("misses"))


def long_queues(spans: DataFrame, over: int = 900) -> DataFrame:
    return spans.where(F.col("queue_wait_millis") > over).select("trace_id", "label", "queue_wait_millis", "start_time_unix_millis")


def command_averages(spans: DataFrame) -> DataFrame:
    return spans.where("command_duration_millis > 0").groupBy("label").agg(F.avg("command_duration_millis").alias("avg_command_millis"), F.count("*").alias("runs"))


def slowest_span(builds: DataFrame, spans: DataFrame, n: int = 1) -> DataFrame:
    rows = spans.join(builds.select("trace_id"), "trace_id", "left_semi").select("trace_id", "label", "total_duration_millis")
    return rows.orderBy(F.col("total_duration_millis").desc(), "trace_id", "label").limit(n)


def failed_builds(builds: DataFrame) -> DataFrame:
    return builds.where("failure_count > 0").select("trace_id", "command", "failure_count", "total_duration_millis")


def dashboard(builds: DataFrame) -> DataFrame:
    """The series of a dashboard: one row per build by time."""
    return builds.select("start_time_unix_millis", "trace_id", "total_duration_millis", "critical_path_exec_millis", "cache_hit_count", "total_targets", "failure_count").orderBy("start_time_unix_millis", "trace_id")

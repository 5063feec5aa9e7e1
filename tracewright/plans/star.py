"""Traces and graphs out of star-schema tables, so that every operator can run on data of any size.

Orders stand for builds, line items for their spans; parts form a dependency graph in which part p needs parts p div 2
and p div 3 (with diamonds). Measures are whole numbers, so that sums and averages don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(column: str) -> Column:
    """Epoch milliseconds of a timestamp without zone, taken as UTC."""
    return F.unix_millis(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def spans(spark: SparkSession, sf_dir: str, by_trace: bool = False) -> DataFrame:
    """With ``by_trace``, items are dealt by trace before their columns are worked out: for joins with builds, whose
    shuffle would move twice as many columns."""
    s = F.col("l_suppkey")
    li = table(spark, sf_dir, "lineitem")
    if by_trace:
        li = li.repartition(F.col("l_orderkey").cast("string"))
    out = li.select(
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.concat(F.lit("//s"), F.pmod(s, F.lit(10)).cast("string"), F.lit(":t"), s.cast("string")).alias("label"),
        F.concat(F.lit("s"), F.pmod(s, F.lit(10)).cast("string")).alias("package"),
        F.col("l_partkey").cast("string").alias("change_hash"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-out")).alias("output_hash"),
        F.when(F.col("l_returnflag") == "R", "FAILURE").otherwise("SUCCESS").alias("status"),
        F.when(F.col("l_linestatus") == "O", "CACHE_MISS").otherwise("CACHE_HIT").alias("cache_result"),
        F.concat(F.lit("make "), F.col("l_partkey").cast("string")).alias("command"),
        F.lit(0).alias("exit_code"),
        (F.col("l_linenumber") == 1).alias("is_test"),
        (_millis("l_shipdate") + F.col("l_linenumber") * 1000).alias("start_time_unix_millis"),
        _whole(F.col("l_quantity") * 20).alias("queue_wait_millis"),
        _whole(F.col("l_tax") * 6000 + 0.5).alias("hash_duration_millis"),
        F.col("l_linenumber").cast("long").alias("cache_check_millis"),
        _whole(F.col("l_extendedprice")).alias("command_duration_millis"),
        _whole(F.col("l_quantity") * 30).alias("output_write_millis"),
        _whole(F.col("l_discount") * 10000 + 0.5).alias("output_load_millis"),
        (F.col("l_linenumber") * 100).cast("long").alias("cache_write_millis"),
        F.pmod(F.col("l_partkey"), F.lit(50)).cast("long").alias("dep_load_millis"),
        F.concat(F.lit("tag"), F.pmod(F.col("l_linenumber"), F.lit(3)).cast("string")).alias("tags"),
        F.lit("").alias("dependencies"),
    )
    total = sum((F.col(c) for c in ("hash_duration_millis", "cache_check_millis", "command_duration_millis", "output_write_millis", "output_load_millis", "cache_write_millis", "dep_load_millis")), F.col("queue_wait_millis"))
    out = out.withColumn("total_duration_millis", total)
    return out.withColumn("end_time_unix_millis", F.col("start_time_unix_millis") + F.col("total_duration_millis"))


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").cast("int").alias("total_targets"), F.count_if(F.col("l_returnflag") == "R").cast("int").alias("failure_count"), F.count_if(F.col("l_linestatus") == "F").cast("int").alias("cache_hit_count")
    )
    o = table(spark, sf_dir, "orders").join(li, "o_orderkey", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return o.select(
        F.col("o_orderkey").cast("string").alias("trace_id"),
        F.lit("w").alias("workspace"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("git_commit"),
        F.lit("main").alias("git_branch"),
        F.lit("1").alias("tool_version"),
        F.lit("linux/amd64").alias("platform"),
        F.col("o_orderpriority").alias("command"),
        _millis("o_orderdate").alias("start_time_unix_millis"),
        _whole(F.col("o_totalprice")).alias("total_duration_millis"),
        n("total_targets").alias("total_targets"),
        (n("total_targets") - n("failure_count")).alias("success_count"),
        n("failure_count").alias("failure_count"),
        n("cache_hit_count").alias("cache_hit_count"),
        _whole(F.col("o_totalprice") / 2).alias("critical_path_exec_millis"),
        F.lit(0).cast("long").alias("critical_path_cache_millis"),
        F.lit(0).cast("long").alias("async_cache_wait_millis"),
        (F.col("o_orderstatus") == "F").alias("is_ci"),
        F.lit("//...").alias("requested_patterns"),
    )


def _parts(spark: SparkSession, sf_dir: str, spread: bool) -> DataFrame:
    """With ``spread``, parts are dealt to as many tasks as run at once: their file is small, and makes a few tasks only."""
    p = table(spark, sf_dir, "part")
    return p.repartition(spark.sparkContext.defaultParallelism, "p_partkey") if spread else p


def part_label(key: Column) -> Column:
    """Packages of two levels: //g<key mod 7>/p<key mod 50>:n<key>; every 40th part is a test."""
    return F.concat(F.lit("//g"), F.pmod(key, F.lit(7)).cast("string"), F.lit("/p"), F.pmod(key, F.lit(50)).cast("string"), F.lit(":n"), key.cast("string"), F.when(F.pmod(key, F.lit(40)) == 0, "_test").otherwise(""))


def edges(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(src, dst) by label."""
    p = _parts(spark, sf_dir, spread).select(F.col("p_partkey").alias("p"))
    needs = p.select("p", F.explode(F.array_distinct(F.array(F.expr("p div 2"), F.expr("p div 3")))).alias("d")).where("d >= 1")
    return needs.select(part_label(F.col("d")).alias("src"), part_label(F.col("p")).alias("dst"))


def nodes(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    p = F.col("p_partkey")
    t = _parts(spark, sf_dir, spread)
    kind = F.when(F.pmod(p, F.lit(97)) == 0, "resource").otherwise("target")
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    p_text = p.cast("string")
    file = lambda name: F.struct(F.lit("file").alias("type"), name.alias("identifier"))
    return t.select(
        part_label(p).alias("label"),
        F.concat(F.lit("g"), F.pmod(p, F.lit(7)).cast("string"), F.lit("/p"), F.pmod(p, F.lit(50)).cast("string")).alias("package"),
        F.regexp_extract(part_label(p), ":(.*)$", 1).alias("name"),
        kind.alias("node_type"),
        F.when(F.pmod(p, F.lit(80)) == 0, "").otherwise(F.col("p_name")).alias("command"),
        F.array(text("src", p_text, ".txt"), text(F.when(F.pmod(p, F.lit(111)) == 0, "../up").otherwise("lib"), (F.expr("p_partkey div 4")).cast("string"), ".txt")).alias("inputs"),
        F.array(file(text("out/", F.expr("p_partkey div 2").cast("string"), ".bin"))).alias("outputs"),
        F.when(F.pmod(p, F.lit(25)) == 0, file(text("bin", p_text))).otherwise(F.lit(None)).alias("bin_output"),
        F.array(text("tag", F.pmod(p, F.lit(5)).cast("string")), F.col("p_brand")).alias("tags"),
        F.when(F.pmod(p, F.lit(13)) == 0, F.array(F.lit("darwin/arm64"))).otherwise(F.array().cast("array<string>")).alias("platforms"),
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("fingerprint"),
        text(F.concat(F.lit("g"), F.pmod(p, F.lit(7)).cast("string"), F.lit("/p"), F.pmod(p, F.lit(50)).cast("string")), "/BUILD.json").alias("source_file_path"),
        F.lit(None).cast("string").alias("actual"),
        F.col("p_size").cast("long").alias("execution_millis"),
        F.pmod(p, F.lit(3)).cast("long").alias("cache_millis"),
    )

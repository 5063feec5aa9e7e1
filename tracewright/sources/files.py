"""Files as tables: listings, contents, sizes, logs and input globs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scalars import clean_path, megabytes
from tracewright.storage import stage

_WILD = re.compile(r"[*?\[{]")


def listing(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """(key, length, modified) of all files below a root; keys are relative. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select(_relative(F.col("path"), root).alias("key"), "length", F.col("modificationTime").alias("modified"))


def _relative(path: Column, root: str) -> Column:
    bare = re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/") + "/"
    return F.substring_index(F.regexp_replace(path, "^[a-z0-9]+:/+", "/"), bare, -1)


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file, content): whole files by relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(_relative(F.col("path"), root).alias("file"), "content")


def folder_size(spark: SparkSession, root: str) -> DataFrame:
    """One row: files, bytes, megabytes."""
    total = listing(spark, root).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("bytes"))
    return total.select("files", "bytes", megabytes(F.col("bytes")).alias("megabytes"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a target's log."""
    return spark.read.text(path)


def glob_regex(glob: Column) -> Column:
    """A glob as a regular expression over relative paths: ** crosses folders, * and ? don't; [..] and {..} choose.
    Marks below blank stand for what is special until everything else is escaped."""
    steps = (
        (r"\{([^{}]*)\}", "\x01$1\x02"),
        (r",(?=[^\x01\x02]*\x02)", "\x03"),
        (r"\[([^\]]+)\]", "\x04$1\x05"),
        (r"[.+^$()|\\{}\[\]]", r"\\$0"),
        (r"\x04!", "\x04^"),
        (r"\*\*/(?![^\x04\x05]*\x05)", "\x06"),
        (r"\*\*(?![^\x04\x05]*\x05)", ".\x07"),
        (r"\*(?![^\x04\x05]*\x05)", "[^/]*"),
        (r"\?(?![^\x04\x05]*\x05)", "[^/]"),
        (r"\x01", "(?:"),
        (r"\x02", ")"),
        (r"\x03", "|"),
        (r"\x04", "["),
        (r"\x05", "]"),
        (r"\x06", "(?:.*/)?"),
        (r"\x07", "*"),
    )
    for found, put in steps:
        glob = F.regexp_replace(glob, found, put)
    return F.concat(F.lit("^"), glob, F.lit("$"))


#: Labels with the same globs that one row of their files serves.
SHARED = 1_024


def expand_inputs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes (label, package, inputs, exclude_inputs) and a listing (key) -> (label, input): globs give the files that
    they match, plain paths pass unchecked, excluded ones go.

    Globs are matched once for all labels that ask the same in the same package. The rows of the result come about in the
    last join, which deals the labels of an ask into groups of about SHARED, and are not shuffled.
    """
    none = F.array().cast("array<string>")
    listed = lambda column, excluded: F.transform(F.coalesce(column, none), lambda glob: F.struct(F.lit(excluded).alias("excluded"), "package", glob.alias("glob")))
    # All that a label asks, in whatever rows.
    each = nodes.select("label", F.explode(F.concat(listed("inputs", False), listed("exclude_inputs", True))).alias("a")).where("a.glob IS NOT NULL")
    asks = each.groupBy("label").agg(F.array_sort(F.collect_set("a")).alias("all"))
    asks = stage(asks.select("label", "all", F.sha2(F.to_json("all"), 256).alias("ask")), "asks")
    kinds = stage(asks.groupBy("ask").agg(F.first("all").alias("all"), F.ceil(F.count("*") / SHARED).cast("int").alias("groups")), "ask-kinds")
    asked = kinds.select("ask", F.inline("all"))

    # Files meet globs by folder first: each file under each of its parents, each glob under its package and the folders
    # that it names in full, in an equi-join.
    plain = asked.where(~F.col("glob").rlike(_WILD.pattern)).select("ask", "excluded", clean_path(F.col("glob")).alias("input"))
    wild = asked.where(F.col("glob").rlike(_WILD.pattern))
    named = F.regexp_extract("glob", r"^(?:[^*?\[{]*/)?", 0)
    folder = F.concat_ws("/", F.when(F.col("package") != "", F.col("package")), F.when(F.length("named") > 1, F.regexp_replace("named", "/+$", "")))
    wild = wild.withColumn("named", named).select("ask", "excluded", "named", folder.alias("folder"), glob_regex(F.expr("substring(glob, length(named) + 1)")).alias("regex"))
    parts = F.split("key", "/")
    parents = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    under = files.where("contains(key, '/')").select("key", F.explode(parents).alias("folder")).union(files.where("NOT contains(key, '/')").select("key", F.lit("").alias("folder")))
    inside = under.select("folder", F.when(F.col("folder") == "", F.col("key")).otherwise(F.expr("substring(key, length(folder) + 2)")).alias("rest"))
    found = wild.join(inside, "folder").where(F.expr("rlike(rest, regex)")).select("ask", "excluded", F.concat("named", "rest").alias("input"))
    kept = plain.union(found).groupBy("ask", "input").agg(F.bool_or("excluded").alias("excluded")).where("NOT excluded")

    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.sparkSession.sparkContext.defaultParallelism)
    shared = kept.join(kinds.select("ask", "groups"), "ask").select("ask", "input", F.explode(F.expr("sequence(0, groups - 1)")).alias("group"))
    dealt = asks.select("label", "ask").join(kinds.select("ask", "groups"), "ask").select("label", "ask", F.expr("CAST(pmod(xxhash64(label), groups) AS INT)").alias("group"))
    return dealt.repartition(tasks, "ask", "group").join(shared.repartition(tasks, "ask", "group").hint("merge"), ["ask", "group"]).select("label", "input")

"""Filter interaction audit: what each filter removes alone, after others, and on average over all orders.

Every document becomes one bit mask of the filters that it fails, and documents fold into cells (part, mask) with their
counts: at most 2^filters cells a part, whatever the corpus. In long form, each cell meets each step of each order of the
filters; a running bit-or over the earlier steps tells whether the cell is still there, conditional sums give the
metrics of a step, and a window over all orders gives the filter's Shapley total.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import SPACE, stage

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct words), C (capitals) and D (symbols)."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_UPPER_PERCENT * F.length(text), text.rlike(SYMBOLS)]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the filters that each document fails, bit k for filter k; n equal rows are one.

    The last filter fails a text that a smaller doc_id has. Of equal texts, the rows of the smallest id are found again
    by id and digest, so that no group of copies meets in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = stage(seen.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), bits.alias("mask")).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit-masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    known = rows.where(F.col("doc_id").isNotNull()).join(first, ["doc_id", "digest"], "left")
    copied = F.when(F.col("first").isNull(), 1 << len(FILTERS) - 1).otherwise(0)
    out = known.select("doc_id", "part", F.col("mask").bitwiseOR(copied).alias("mask"), "n")
    return out.unionByName(rows.where(F.col("doc_id").isNull()).select("doc_id", "part", "mask", "n"))


def cells(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): the masks of documents folded, with what the labels say about them."""
    flag = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("long")), F.lit(0)).alias(name)
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    known = found.where(F.col("doc_id").isNotNull()).join(marked, "doc_id", "left").select("part", "mask", "n", "quality", "toxic")
    rest = found.where(F.col("doc_id").isNull()).select("part", "mask", "n", F.lit(None).cast("long").alias("quality"), F.lit(None).cast("long").alias("toxic"))
    total = lambda name: F.coalesce(F.sum(F.col("n") * F.col(name)), F.lit(0))
    return known.unionByName(rest).groupBy("part", "mask").agg(F.sum("n").alias("docs"), total("quality").alias("good"), total("toxic").alias("toxic"))


def evaluate(folded: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit's long form from cells: one row per part, order of the filters and step."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    step = lambda: F.posexplode(F.split("filter_order", ""))
    long = folded.select("*", F.explode(orders).alias("filter_order")).select("*", step().alias("at", "filter"))
    bit = F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)")
    fails = F.col("mask").bitwiseAND(bit)
    earlier = F.coalesce(F.bit_or(fails).over(Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = long.select("*", fails.alias("fails"), bit.alias("bit"), earlier.alias("earlier"))
    gone, fresh = F.col("fails") != 0, F.col("earlier") == 0
    when = lambda condition, name="docs": F.sum(F.when(condition, F.col(name)).otherwise(0))
    steps = seen.groupBy("part", "filter_order", "at", "filter").agg(
        when(fresh & ~gone).alias("kept"), when(fresh & gone).alias("removed"), when(gone & ~fresh).alias("redundant"), when(F.col("mask") == F.col("bit")).alias("unique_fails"),
        when(fresh & gone, "good").alias("good_lost"), when(fresh & gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps.select("part", "filter_order", (F.col("at") + 1).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source value), order of the five filters and step, zeros included.

    Null texts count as empty and null sources as the empty string; texts of any length are read whole. Rows that repeat
    each count. A null doc_id is neither smaller nor larger than another and has no label; rows of one id don't fail
    each other. Contradicting labels of an id both count. No documents give no rows; other columns are ignored.
    """
    return evaluate(cells(masks(docs), labels))

"""Mixing sources to target weights by a time-varying curriculum.

Every source owns a weight schedule over training time t in [0, 1]: linear from ``start`` to ``end``. Its integral
D(t) is the share of the source's tokens that training has consumed at t. A document that covers the source's tokens
from ``first`` on therefore belongs at the t with D(t) = first / target, which is a quadratic equation in t. Sorting by
position (range partitioned) yields the training order.

Everything runs on DataFrame functions. A source may hold any part of all rows: running sums are split into buckets of
a hash, first summed per bucket and then within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.llm.common import WORD, free, stage

#: Base weights, dealt to the sources by their order, again and again.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes.
BUDGET = 1.5
#: No source and no document is taken more often than this.
MAX_REPEATS = 2
#: Slope of the schedules, by the same order: below 0 a source comes early, above 0 late.
SLOPES = (-0.5, 0.0, 0.5)
#: Rows of a source in one bucket of the running sums, on average.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS, slopes=SLOPES) -> DataFrame:
    """One row per source (source, source_size, n_docs) -> the same with target, weight and slope.

    Sources are ordered by code point, null last. Targets are weight * level, but at most ``repeats`` times the
    source's size; the level is the one at which they add up to ``budget`` times all sizes. With the sources ordered
    by the level at which they saturate, the answer is the first position whose level doesn't exceed the next
    saturation, so one running sum replaces the repeated resharing.
    Sources without words get target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = F.row_number().over(by_name) - 1
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (index % len(values) + 1).cast("int"))
    s = sizes.select("*", pick(weights, "double").alias("weight"), pick(slopes, "double").alias("slope"))
    s = s.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget))).withColumn("weights", F.sum("weight").over(everything))
    s = s.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    s = s.withColumn("place", F.row_number().over(order))
    s = s.withColumn("found", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("place", "level"))).over(everything)["level"])
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("found")))
    return s.select("source", "source_size", "n_docs", "weight", "slope", target.cast("double").alias("target"))


def position(share: Column, slope: Column) -> Column:
    """The t at which a schedule 1 - slope + 2 * slope * t (integral 1) has consumed ``share``."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * c)
    return F.when(slope == 0, c).otherwise((root - (1 - slope)) / (2 * slope))


def _match(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS, slopes=SLOPES, bucket_rows: int = BUCKET_ROWS, key: Column | None = None) -> DataFrame:
    """Assign every document of (doc_id, text, source) the words that the mix takes and its training positions.

    Returns per input row doc_id, source, key, size, source_size, target, taken and copies: an array with position and
    words taken of each copy. Within a source documents follow ``key``, by default a hash of doc_id and text, the same on
    every run; equal keys follow the doc_id, and rows that repeat both are alike. Copies are taken round by round, the
    last one is cut at the target. Null texts have size 0, so they are taken nowhere (taken 0, no copies); texts of any
    length are counted whole; a null source is a source of its own; repeated rows count each; an empty table gives no
    rows; other columns are ignored.
    """
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), (row_key() if key is None else key).alias("key")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = stage(source_targets(sizes, weights, budget, repeats, slopes), "mix-plan")
    named = plan.withColumnRenamed("source", "_source").withColumn("buckets", F.ceil(F.col("n_docs") / bucket_rows).cast("long"))
    # AQE splits a source that holds much of the rows; a short plan is broadcast by its measured size.
    rows = rows.join(named, _match("source", "_source")).drop("_source", "weight", "n_docs")
    # The bucket is monotone in the key, so that buckets follow each other in the order of the keys.
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("unit", unit).withColumn("bucket", F.floor(F.col("unit") * F.col("buckets")))
    heads = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(heads, _match("source", "_source") & _match("bucket", "_bucket"))
    # Copy r of a document covers the words [start, start + size) of the source repeated without end.
    start = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: r * F.col("source_size") + F.col("ahead") + F.col("inner"))
    rows = rows.withColumn("starts", F.filter(start, lambda x: (x < F.round("target")) & (F.col("size") > 0)))
    part = lambda x: F.least(F.col("size"), (F.round("target") - x).cast("long"))
    copies = F.transform("starts", lambda x: F.struct(position(x / F.col("target"), F.col("slope")).alias("position"), part(x).alias("taken")))
    taken = F.aggregate("starts", F.lit(0).cast("long"), lambda acc, x: acc + part(x))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` range-sorted by the position of their first copy; what isn't taken comes last. Further columns:
    position and again, the positions of the first and the second copy."""
    at = lambda k: F.try_element_at("copies", F.lit(k))["position"]
    placed = mixed.select("*", at(1).alias("position"), at(2).alias("again"))
    order = (F.col("position").asc_nulls_last(), F.col("doc_id"))
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def row_key() -> Column:
    """Orders the documents of a source; the same for repeated rows only."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def training_set(docs: DataFrame, **options) -> DataFrame:
    """The mix in training order: the columns of docs with mix_size, mix_taken and mix_position (with _ behind, if docs has
    such a name), one row per copy, range-sorted by position.

    mix_taken is how many words of the copy belong to the mix: all but for the last copy of a source, which its target
    cuts; the text stays whole. Documents that the mix doesn't take are left out. Rows that are alike in all columns stand
    for one another; all others keep their own.
    """
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    whole = F.md5(F.concat_ws(":", row_key(), F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])) if others else F.lit("")))
    mixed = mix(docs, key=whole, **options).where(F.size("copies") > 0).select("key", "source", "size", "copies")
    mixed = stage(mixed.groupBy("source", "key", "size").agg(F.flatten(F.collect_list("copies")).alias("copies"), F.count("*").alias("n")), "mix-taken")
    key, other, source, size, given, place = (free(docs, c) for c in ("_key", "_key2", "_source", "mix_size", "mix_taken", "mix_position"))
    rows = docs.withColumn(key, whole)
    if not mixed.where("n > 1").isEmpty():  # rows that are alike: their copies stand together
        rows = rows.dropDuplicates([key, "source"])
    spots = free(docs, "_spots")
    taken = mixed.select(F.col("source").alias(source), F.col("key").alias(other), F.col("size").alias(size), F.col("copies").alias(spots))
    rows = rows.join(taken.hint("shuffle_hash"), (F.col(key) == F.col(other)) & _match("source", source)).select(*docs.columns, size, F.explode(spots).alias(spots))
    rows = rows.select(*docs.columns, size, F.col(spots)["taken"].alias(given), F.col(spots)["position"].alias(place))
    return rows.repartitionByRange(place, "doc_id").sortWithinPartitions(place, "doc_id")

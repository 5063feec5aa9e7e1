"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.storage import shared_dir, stage, unstage  # noqa: F401  the operators take them from here

#: The white space of the text contracts: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
#: A word of the text contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, most: int = 20_000) -> DataFrame:
    """Inner join of rows to one group record per key, where a group may hold a large part of all rows.

    Groups above total / most rows number fewer than ``most`` (their sizes add up to ``total``), so that this
    list can be broadcast whatever the input; all other groups are small and go through a shuffle join.
    Both inputs are read twice, so pass staged tables. Rows without a group are dropped; null keys match.
    """
    limit = max(1_000, total // most)
    extra = [c for c in groups.columns if c != key]
    g = groups.withColumnRenamed(key, "_k")
    heavy = F.broadcast(g.where(F.col(size) > limit))
    light = g.where(F.col(size) <= limit)
    same = F.col(key).eqNullSafe(F.col("_k"))
    hot = rows.join(heavy, same, "inner")
    rest = rows.join(heavy.select("_k"), same, "left_anti").join(light.hint("shuffle_hash"), same, "inner")
    return hot.unionByName(rest).select(*rows.columns, *extra)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null counts as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus

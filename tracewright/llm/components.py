"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import stage

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to the least neighbour."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
    joined = down.join(least, F.col("u") == F.col("_u"))
    ends = F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b"))))
    return joined.select(ends).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root), root the least node of its component; nodes without edges don't appear."""
    current = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "components")
    before = None
    for _ in range(MAX_ROUNDS):
        now = _state(current)
        if now == before or not now[0]:
            break
        before = now
        current = stage(_small_star(_large_star(current)), "components")
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    stars = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

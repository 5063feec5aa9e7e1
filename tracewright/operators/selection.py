"""Selection of graph nodes: patterns, tags, platforms and target types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.labels import Pattern, any_pattern, is_test
from tracewright.operators import graph
from tracewright.operators.graph import reachable
from tracewright.storage import stage

TYPES = ("all", "test", "no_test", "bin_output")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_tag(tags: Sequence[str]) -> Column:
    """Any of the tags; without tags everything."""
    return F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), _strings(tags)) if tags else F.lit(True)


def lacks_tags(tags: Sequence[str]) -> Column:
    return ~has_tag(tags) if tags else F.lit(True)


def fits_platform(host: str, enabled: Sequence[str] = (), every: bool = False) -> Column:
    """Nodes that aren't targets always fit, as do targets without platforms."""
    if every:
        return F.lit(True)
    own = F.coalesce("platforms", F.array().cast("array<string>"))
    return (F.col("node_type") != "target") | (F.size(own) == 0) | F.array_contains(own, host) | (F.arrays_overlap(own, _strings(enabled)) if enabled else F.lit(False))


def of_type(kind: str) -> Column:
    if kind not in TYPES:
        raise ValueError(f"target type {kind!r} is none of {TYPES}")
    if kind == "bin_output":
        return F.coalesce(F.col("bin_output")["identifier"], F.lit("")) != ""
    return {"all": F.lit(True), "test": is_test(F.col("label")), "no_test": ~is_test(F.col("label"))}[kind]


def selected(patterns: Sequence[Pattern] = (), tags: Sequence[str] = (), exclude_tags: Sequence[str] = (), kind: str = "all") -> Column:
    """Targets need pattern, tags and type; other nodes the pattern alone."""
    if set(tags) & set(exclude_tags):
        raise ValueError(f"tags both wanted and excluded: {sorted(set(tags) & set(exclude_tags))}")
    pattern = any_pattern(list(patterns), F.col("package"), F.col("name"))
    return pattern & ((F.col("node_type") != "target") | (has_tag(tags) & lacks_tags(exclude_tags) & of_type(kind)))


def list_nodes(nodes: DataFrame, host: str | None = None, **options) -> DataFrame:
    """Labels of the selected nodes, sorted."""
    found = nodes.where(selected(**options))
    return (found.where(fits_platform(host)) if host else found).select("label").orderBy("label")


def build_selection(nodes: DataFrame, edges: DataFrame, host: str, enabled: Sequence[str] = (), every: bool = False, **options) -> DataFrame:
    """Nodes that a build needs: (label, chosen, ancestor, platform_error) for what is selected and all it depends on.

    A selected node that doesn't fit the platform is skipped: it is left out. One that only a dependant needs is an
    error of the build: its row says so.
    """
    fits = fits_platform(host, enabled, every)
    picked = nodes.where(selected(**options))
    chosen = picked.where(fits).select("label")
    needed = reachable(edges, chosen, "deps").withColumnRenamed("label", "_label")
    own = chosen.withColumnRenamed("label", "_chosen")
    rows = nodes.join(needed, F.col("label") == F.col("_label"), "left").join(own, F.col("label") == F.col("_chosen"), "left")
    rows = rows.select("label", F.col("_chosen").isNotNull().alias("chosen"), F.col("_label").isNotNull().alias("ancestor"), (F.col("_label").isNotNull() & ~fits).alias("platform_error"))
    return rows.where("chosen OR ancestor")


def platform_error(nodes: DataFrame, edges: DataFrame, host: str, enabled: Sequence[str] = (), every: bool = False, **options) -> DataFrame:
    """(label, chain, message): why a build can't be selected, for the smallest label that doesn't fit the platform although
    a selected node needs it: the shortest chain from such a node to it. No row if all fit."""
    fits = fits_platform(host, enabled, every)
    chosen = stage(nodes.where(selected(**options)).where(fits).select("label"), "selected")
    ways = stage(graph.explored(edges, chosen, "deps"), "needed")
    misfit = nodes.where(~fits).select("label").join(ways.select("label"), "label", "left_semi").agg(F.min("label").alias("label")).where("label IS NOT NULL")
    back = ways.join(chosen, "label", "left_anti").select(F.col("label").alias("here"), F.col("previous").alias("there"))
    chain = graph.followed(back, misfit).agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"])).alias("chain")).where("size(chain) > 0")
    tags = f" (active platform tags: [{' '.join(enabled)}])" if enabled else ""
    text = F.concat(F.lit("could not select node "), F.get("chain", F.lit(0)), F.lit(" because it depends on "), F.array_join(F.slice("chain", 2, F.size("chain")), " -> "), F.lit(f", which does not match the platform {host}{tags}"))
    return chain.select(F.get("chain", F.lit(0)).alias("label"), "chain", text.alias("message"))


def selection_counts(nodes: DataFrame, host: str, **options) -> DataFrame:
    """One row: selected and skipped for their platform."""
    fits = fits_platform(host)
    return nodes.where(selected(**options)).agg(F.count_if(fits).alias("selected"), F.count_if(~fits).alias("platform_skipped"))

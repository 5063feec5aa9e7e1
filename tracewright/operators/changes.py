"""What a set of changed files means for a graph: owners, changed targets, affected nodes, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import clean_path
from tracewright.operators.graph import induced, reachable, roots
from tracewright.operators.selection import selected
from tracewright.storage import stage


def input_files(nodes: DataFrame) -> DataFrame:
    """(label, file): every input of a target as a path from the workspace's root."""
    rows = nodes.where("node_type = 'target'").select("label", "package", F.explode("inputs").alias("input"))
    joined: Column = F.when(F.col("package") == "", F.col("input")).otherwise(F.concat_ws("/", "package", "input"))
    return rows.select("label", clean_path(joined).alias("file"))


def definition_files(nodes: DataFrame) -> DataFrame:
    """(label, file): where each target is defined."""
    return nodes.where("node_type = 'target'").select("label", F.col("source_file_path").alias("file"))


def changed_files(*relations: DataFrame) -> DataFrame:
    """Distinct files of several diffs: commits, staged, unstaged and untracked."""
    out = relations[0].select("file")
    for r in relations[1:]:
        out = out.union(r.select("file"))
    return out.distinct()


def owners(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Targets that have one of the files among their inputs, by exact path."""
    return input_files(nodes).join(files.select("file"), "file", "left_semi").select("label").distinct().orderBy("label")


def touched(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, label): targets that read a changed file or are defined in one, once per pair."""
    return input_files(nodes).unionByName(definition_files(nodes)).join(files.select("file"), "file", "left_semi").select("file", "label").distinct()


def affected(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Labels of what the files touch and of all that depends on it, staged: they are worked out once however often they
    are read."""
    direct = stage(touched(nodes, files).select("label").distinct(), "touched")
    return stage(direct.union(reachable(edges, direct, "rdeps")).distinct(), "affected")


def changes(nodes: DataFrame, edges: DataFrame, files: DataFrame, dependents: str = "none", **selection) -> DataFrame:
    """Changed targets, with ``dependents='transitive'`` also the targets that depend on them. Type and tags filter
    after the expansion."""
    if dependents not in ("none", "transitive"):
        raise ValueError(f"dependents {dependents!r} is neither none nor transitive")
    found = affected(nodes, edges, files) if dependents == "transitive" else touched(nodes, files).select("label").distinct()
    targets = nodes.where(F.col("node_type") == "target").where(selected(**selection))
    return targets.join(found, "label", "left_semi").select("label").orderBy("label")


def affected_index(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(label, files): the affected nodes with the changed files that touch them directly, sorted."""
    per = touched(nodes, files).groupBy("label").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return affected(nodes, edges, files).join(per, "label", "left").select("label", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def consumer_roots(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Affected nodes on which no other affected node depends."""
    return roots(affected(nodes, edges, files), edges).orderBy("label")


def affected_edges(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    return induced(affected(nodes, edges, files), edges)

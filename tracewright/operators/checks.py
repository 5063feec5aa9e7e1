"""Consistency checks of a graph. Each gives rows (check, label, detail, severity); all of them are unioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.labels import is_test
from tracewright.functions.scalars import clean_path, escapes
from tracewright.operators.graph import GraphError, _jumps, accumulate, induced, resolve_aliases, self_loops, unresolved
from tracewright.storage import stage, unstage

_NONE = "array<string>"


def _found(df: DataFrame, check: str, detail: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(check).alias("check"), "label", detail.cast("string").alias("detail"), F.lit(severity).alias("severity"))


def duplicate_labels(nodes: DataFrame) -> DataFrame:
    """Labels that several nodes have, of whatever kinds and files."""
    rows = nodes.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return _found(rows, "duplicate_label", F.col("n"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _found(unresolved(nodes, edges), "missing_dependency", F.col("dependency"))


def loops(edges: DataFrame) -> DataFrame:
    return _found(self_loops(edges), "self_dependency", F.col("label"))


def _targets(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'target'")


def _outputs(nodes: DataFrame) -> DataFrame:
    """(label, package, type, identifier) of all outputs, the binary's included."""
    every = F.concat(F.coalesce("outputs", F.array().cast("array<struct<type: string, identifier: string>>")), F.when(F.col("bin_output").isNotNull() & (F.col("bin_output")["identifier"] != ""), F.array("bin_output")).otherwise(F.array().cast("array<struct<type: string, identifier: string>>")))
    return _targets(nodes).select("label", "package", F.inline(every))


def constraints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths, commands, tests and image pushes."""
    targets = _targets(nodes)
    inputs = targets.select("label", F.explode("inputs").alias("input"))
    absolute = F.col("input").startswith("/")
    out = _found(inputs.where(absolute), "absolute_input", F.col("input")).unionByName(_found(inputs.where(~absolute & escapes(F.col("input"))), "escaping_input", F.col("input")))
    paths = _outputs(nodes).where("type IN ('file', 'dir')").withColumn("path", F.when(F.col("package") == "", F.col("identifier")).otherwise(F.concat_ws("/", "package", "identifier")))
    rooted = F.col("identifier").startswith("/")
    out = out.unionByName(_found(paths.where(rooted), "absolute_output", F.col("identifier"))).unionByName(_found(paths.where(~rooted & escapes(F.col("path"))), "escaping_output", F.col("identifier")))
    out = out.unionByName(_found(targets.where(is_test(F.col("label")) & (F.coalesce("command", F.lit("")) == "")), "test_without_command", F.col("label")))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    idle = targets.where(empty("inputs") & empty("dependencies") & empty("output_checks") & empty("fingerprint"))
    out = out.unionByName(_found(idle, "runs_once", F.col("label"), "warning"))
    pushes = targets.select("label", F.explode(F.map_keys("oci_push")).alias("identifier"))
    images = _outputs(nodes).where("type = 'oci'").select("label", "identifier")
    out = out.unionByName(_found(pushes.join(images, ["label", "identifier"], "left_anti"), "push_without_image", F.col("identifier")))
    return out.unionByName(_dependency_rules(nodes, edges))


def _dependency_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Only tests may depend on tests; only tests and test-only targets on test-only ones. Aliases are looked through."""
    only = F.array_contains(F.coalesce("tags", F.array().cast(_NONE)), "testonly")
    behind = resolve_aliases(nodes).where("target IS NOT NULL")
    tags = _targets(nodes).select(F.col("label").alias("target"), only.alias("needs_test"))
    resolved = edges.join(behind.select(F.col("label").alias("src"), "target"), "src").join(tags, "target")
    users = nodes.where("node_type IN ('target', 'resource')").select(F.col("label").alias("dst"), "node_type", only.alias("only"))
    rows = resolved.join(users, "dst").select(F.col("dst").alias("label"), "target", "node_type", "only", "needs_test", is_test(F.col("target")).alias("on_test"), ((F.col("node_type") == "target") & is_test(F.col("dst"))).alias("by_test"))
    on_test = rows.where("on_test AND NOT by_test")
    on_only = rows.where("NOT on_test AND needs_test AND node_type = 'target' AND NOT only AND NOT by_test")
    return _found(on_test, "depends_on_test", F.col("target")).unionByName(_found(on_only, "depends_on_testonly", F.col("target")))


#: Longs of a label's filter of all that it depends on.
FILTER_WORDS = 4
#: Edges and pairs up to which cutting loose ends off costs more than it saves.
FEW_BETWEEN = 20_000


def _between(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (src, dst) and pairs (a, b) without loose ends, which lie on no way from an a to its b: pairs whose a has no
    dependants or whose b no dependencies, then edges into a label without dependants that is no pair's b, and edges out
    of one without dependencies that is no pair's a.

    One side is cut while a round takes off a quarter of what is left, then the other; so all rounds together read a
    few times the edges and pairs. Works on cycles, whose labels stay.
    """
    ends = [("src", "a", "dst", "b"), ("dst", "b", "src", "a")]
    size, idle, old = None, 0, []
    while idle < 2 and (size is None or size > FEW_BETWEEN):
        near, first, far, last = ends[0]
        alive = stage(edges.select(F.col(near).alias("label")).distinct(), "between-ends")
        pairs = stage(pairs.join(alive.withColumnRenamed("label", first), first, "left_semi").select("a", "b"), "between-pairs")
        wanted = alive.union(pairs.select(last)).distinct()
        edges = stage(edges.join(wanted.withColumnRenamed("label", far), far, "left_semi").select("src", "dst"), "between-edges")
        unstage(*old, alive)
        old, left = [pairs, edges], pairs.count()
        if left == 0:
            break
        left += edges.count()
        if size is not None and left > 0.75 * size:
            ends, idle = ends[::-1], idle + 1
        else:
            idle = 0
        size = left
    return edges, pairs


def ancestors(nodes: DataFrame, edges: DataFrame, among: DataFrame) -> DataFrame:
    """(a, b): b depends on a, directly or not, for the pairs ``among`` (a, b) in either order.

    Loose ends are cut off first, with the pairs that they settle. Reachability labels answer most other pairs: every node
    that is left gets its level, a Bloom filter of all that it depends on, and a place in a spanning forest (the deepest
    dependency is the parent, so a node's level is its depth). A pair whose levels or filters contradict it is dropped;
    one whose lower node has the upper one as forest ancestor, found by jumps of 1, 2, 4, ... levels, holds. The rest walks
    down from b, where the labels still allow a, a level at a step. No table has more rows than nodes, edges and undecided
    pairs on their ways. Labels need an order, so if a cycle is left, walks start from every label of the pairs.
    """
    both = among.select("a", "b").union(among.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, both = _between(edges.select("src", "dst"), both)
    if both.isEmpty():
        return both
    ends = edges.select(F.col("src").alias("label")).union(edges.select("dst")).distinct()
    nodes = stage(nodes.select("label").join(ends, "label", "left_semi").distinct(), "order-ends")
    try:
        labels = stage(accumulate(nodes.select("label", F.lit(1).cast("long").alias("w")), edges, words=FILTER_WORDS).select("label", "level", "previous", "bits"), "order-labels")
    except GraphError:
        return _ancestors_by_walk(edges, both)
    of = lambda name: labels.select(F.col("label").alias(name), F.col("level").alias(f"{name}_level"), F.col("bits").alias(f"{name}_bits"))
    may = lambda bits, level: (F.col("a_level") <= F.col(level)) & F.forall(F.zip_with("a_bits", bits, lambda x, y: x.bitwiseAND(F.bitwise_not(y)) == 0), lambda x: x)
    pairs = both.distinct().join(of("a"), "a").join(of("b"), "b").where(may("b_bits", "b_level") & (F.col("a") != F.col("b"))).select("a", "b", "a_level", "a_bits", "b_level")
    pairs = stage(pairs.select("*", F.col("b").alias("at"), (F.col("b_level") - F.col("a_level")).alias("left")), "ordered")
    known, size = pairs, 0
    highest = pairs.agg(F.max("left")).first()[0] or 0
    for jump in _jumps(labels.where("previous IS NOT NULL").select(F.col("label").alias("here"), F.col("previous").alias("there"))):
        if highest < 1 << size:
            break
        due = F.expr(f"(left >> {size}) % 2 = 1")
        went = known.where(due).join(jump.withColumnRenamed("here", "at"), "at").withColumn("at", F.col("there")).select(*known.columns)
        known, size = stage(known.where(~due).unionByName(went), "ordered"), size + 1
    found = [stage(known.where("a = at").select("a", "b"), "ordered-found")]
    # What neither labels nor forest decide.
    steps = stage(induced(nodes, edges).join(of("src").select("src", F.col("src_level").alias("level"), F.col("src_bits").alias("bits")), "src").select(F.col("dst").alias("at"), F.col("src").alias("next"), "level", "bits"), "ordered-steps")
    frontier, seen = stage(known.where("a <> at").select("a", "b", "a_level", "a_bits", F.col("b").alias("at")), "ordered"), None
    while not frontier.isEmpty():
        seen = frontier.select("a", "b", "at") if seen is None else stage(seen.unionByName(frontier.select("a", "b", "at")), "ordered-seen")
        step = frontier.join(steps, "at").where(may("bits", "level")).select("a", "b", "a_level", "a_bits", F.col("next").alias("at")).distinct()
        met = stage(step.join(seen, ["a", "b", "at"], "left_anti"), "ordered")
        found.append(met.where("a = at").select("a", "b"))
        frontier = stage(met.where("a <> at").join(found[-1], ["a", "b"], "left_anti"), "ordered")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _ancestors_by_walk(edges: DataFrame, both: DataFrame) -> DataFrame:
    """``ancestors`` in a graph with cycles: what each first label of the pairs reaches."""
    wanted = stage(both.distinct(), "ordered-wanted")
    frontier = stage(wanted.select(F.col("a").alias("start"), F.col("a").alias("label")).distinct(), "ordered")
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(edges.select(F.col("src").alias("label"), "dst"), "label").select("start", F.col("dst").alias("label")).distinct()
        frontier = stage(step.join(seen, ["start", "label"], "left_anti"), "ordered")
        seen = stage(seen.unionByName(frontier), "ordered-seen")
    return wanted.join(seen.select(F.col("start").alias("a"), F.col("label").alias("b")), ["a", "b"], "left_semi")


def output_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of targets (a < b) whose outputs overlap, unless one depends on the other: (kind, a, b, path, other).

    Equal files, folders and images meet in an equi-join; a folder over a file or folder meets it by the list of the
    path's parent folders, so that no pair is tried by prefix.
    """
    outs = _outputs(nodes).withColumn("path", F.when(F.col("type") == "oci", F.col("identifier")).otherwise(clean_path(F.when(F.col("package") == "", F.col("identifier")).otherwise(F.concat_ws("/", "package", "identifier")))))
    outs = stage(outs.select("label", "type", "path").distinct(), "outputs")
    left, right = outs.select(F.col("label").alias("l1"), F.col("type").alias("t1"), F.col("path").alias("p1")), outs.select(F.col("label").alias("l2"), F.col("type").alias("t2"), F.col("path").alias("p2"))
    image = F.col("t1") == "oci"
    same = left.join(right, (F.col("p1") == F.col("p2")) & (image == (F.col("t2") == "oci"))).where("l1 < l2").select(F.when(image, "image").otherwise("same_path").alias("kind"), F.col("l1").alias("a"), F.col("l2").alias("b"), F.col("p1").alias("path"), F.col("p2").alias("other"))
    parts = F.split("p2", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = right.where("t2 <> 'oci' AND contains(p2, '/')").select("l2", "p2", F.explode(parents).alias("p1"))
    over = left.where("t1 = 'dir'").join(below, "p1").where("l1 <> l2")
    over = over.select(F.lit("inside_folder").alias("kind"), F.least("l1", "l2").alias("a"), F.greatest("l1", "l2").alias("b"), F.col("p1").alias("path"), F.col("p2").alias("other"))
    pairs = stage(same.unionByName(over).distinct(), "conflicts")
    ordered = ancestors(nodes, edges, pairs.select("a", "b"))
    ordered = ordered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(ordered, ["a", "b"], "left_anti").select("kind", "a", "b", "path", "other").orderBy("a", "b", "path", "other")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything that is wrong with a graph."""
    clash = _found(output_conflicts(nodes, edges).withColumnRenamed("a", "label"), "output_conflict", F.concat_ws(" ", "b", "path", "other"))
    return duplicate_labels(nodes).unionByName(dangling(nodes, edges)).unionByName(loops(edges)).unionByName(constraints(nodes, edges)).unionByName(clash)

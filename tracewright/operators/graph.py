"""Dependency graphs as tables: nodes (label, ...) and edges (src dependency, dst dependant).

Closures go round by round over the edges with staged tables between rounds. Path counts, levels and longest paths contract
chains by pointer doubling and visit each other node once, in the round after the last of its dependencies, so that the
work follows nodes and edges, not paths, and the rounds follow branchings, not depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.storage import stage, unstage

#: Rounds of a walk after which its parts are merged into one table.
MERGED = 16
#: Paths that are listed one by one, at most; beyond, they can only be counted.
MOST_LISTED = 10_000_000


class GraphError(ValueError):
    """A graph that is not what an operator needs, such as one with a cycle."""


def edges_of(nodes: DataFrame) -> DataFrame:
    """(label, dependencies) -> distinct edges; an alias depends on what it stands for (actual)."""
    deps = F.coalesce("dependencies", F.array().cast("array<string>"))
    if "actual" in nodes.columns:
        deps = F.when(F.col("actual").isNotNull() & (F.col("actual") != ""), F.array("actual")).otherwise(deps)
    return nodes.select(F.explode(deps).alias("src"), F.col("label").alias("dst")).distinct()


def unresolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose dependency is no node: (label, dependency)."""
    return edges.join(nodes.select(F.col("label").alias("src")), "src", "left_anti").select(F.col("dst").alias("label"), F.col("src").alias("dependency"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select(F.col("src").alias("label"))


def _stepping(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (here, there): deps walk from dependants to dependencies, rdeps the other way."""
    if direction not in ("deps", "rdeps"):
        raise ValueError(f"direction {direction!r} is neither deps nor rdeps")
    here, there = ("dst", "src") if direction == "deps" else ("src", "dst")
    return edges.select(F.col(here).alias("here"), F.col(there).alias("there"))


def direct(edges: DataFrame, label, direction: str) -> DataFrame:
    """Direct neighbours of one label."""
    return _stepping(edges, direction).where(F.col("here") == F.lit(label)).select(F.col("there").alias("label"))


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "rdeps") -> DataFrame:
    """Distinct labels that can be reached from ``starts`` (label) in one step or more. Works on cycles."""
    return explored(edges, starts, direction).select("label")


def explored(edges: DataFrame, starts: DataFrame, direction: str = "rdeps") -> DataFrame:
    """(label, previous): what can be reached, each with the smallest label from which the shortest ways come."""
    steps = _stepping(edges, direction)
    near = lambda here: steps.join(here.select(F.col("label").alias("here")), "here").groupBy(F.col("there").alias("label")).agg(F.min("here").alias("previous"))
    frontier = stage(near(starts.distinct()), "reach")
    seen = [frontier]
    while not frontier.isEmpty():
        frontier = stage(near(frontier).join(_union(seen).select("label"), "label", "left_anti"), "reach")
        seen.append(frontier)
        if len(seen) >= MERGED:
            seen = [stage(_union(seen), "reach")]
    return _union(seen)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _shortcuts(single: DataFrame) -> DataFrame:
    """(label, near, w, bits): nodes with one dependency -> (label, near, at, hops, gain, bits): the first node behind that
    has none or several, how far it is, and the sum of w and the union of bits on the way, the label's own included.

    Pointer doubling: the rounds follow the logarithm of the longest chain. Rings raise GraphError.
    """
    table = stage(single.select("label", "near", F.col("near").alias("at"), F.lit(1).cast("long").alias("hops"), F.col("w").alias("gain"), "bits"), "shortcuts")
    for _ in range(max(1, table.count()).bit_length() + 1):
        onward = table.select(F.col("label").alias("at"), F.col("at").alias("beyond"), F.col("hops").alias("more"), F.col("gain").alias("further"), F.col("bits").alias("others"))
        went = F.col("beyond").isNotNull()
        joined = table.join(onward, "at", "left").select(
            "label", "near", F.coalesce("beyond", "at").alias("at"), F.when(went, F.col("hops") + F.col("more")).otherwise(F.col("hops")).alias("hops"),
            F.when(went, F.col("gain") + F.col("further")).otherwise(F.col("gain")).cast(table.schema["gain"].dataType).alias("gain"), _either("bits", "others").alias("bits"), went.alias("went"),
        )
        new = stage(joined, "shortcuts")
        unstage(table)
        table = new
        if table.where("went").isEmpty():
            return table.drop("went")
    raise GraphError("the graph has a cycle")


def _either(a: str, b: str) -> Column:
    """Bit-or of two arrays of longs; null arrays are empty."""
    return F.when(F.col(b).isNull(), F.col(a)).when(F.col(a).isNull(), F.col(b)).otherwise(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))


def accumulate(nodes: DataFrame, edges: DataFrame, fold: str = "max", words: int = 0) -> DataFrame:
    """nodes (label, w) -> (label, level, value, previous, bits): value is w plus the fold (max or sum) of the values of the
    dependencies, level one more than their highest, previous the dependency with the highest value (of equal ones the
    smallest label), bits a filter of ``words`` longs that has one bit for the label and all that it depends on.

    Chains are contracted first: a node with one dependency gets its values from the first node behind it that has none
    or several, so the rounds follow the branchings on a way, not its length. Each of those other nodes is visited once,
    when as many messages have come as it has dependencies. Cycles raise GraphError.
    """
    labels = nodes.select("label")
    inner = edges.select("src", "dst").distinct().join(labels.withColumnRenamed("label", "src"), "src", "left_semi").join(labels.withColumnRenamed("label", "dst"), "dst", "left_semi")
    inner = stage(inner, "order-edges")
    at = F.pmod(F.xxhash64("label"), F.lit(64 * max(1, words)))
    own_bits = F.array(*[F.when(F.floor(at / 64) == k, F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(label), {64 * words}) % 64 AS INT))")).otherwise(0).cast("long") for k in range(words)]).cast("array<bigint>")
    own = stage(nodes.select("label", "w", own_bits.alias("bits")).join(inner.groupBy(F.col("dst").alias("label")).agg(F.count("*").alias("needed"), F.min("src").alias("near")), "label", "left"), "order-nodes")
    heads = own.where("needed IS NULL OR needed > 1").drop("near")
    short = _shortcuts(own.where("needed = 1").select("label", "near", "w", "bits"))
    into = inner.join(heads.where("needed > 1").select(F.col("label").alias("dst")), "dst", "left_semi")
    cut = short.select(F.col("label").alias("src"), "at", "hops", "gain", F.col("bits").alias("on_way"))
    kind = nodes.schema["w"].dataType
    into = stage(into.join(cut, "src", "left").select(F.coalesce("at", "src").alias("at"), "src", "dst", F.coalesce("hops", F.lit(0)).alias("hops"), F.coalesce(F.col("gain"), F.lit(0).cast(kind)).alias("gain"), "on_way"), "order-into")
    folded = {"max": F.max("value"), "sum": F.sum("value").cast(kind)}[fold]
    unite = F.array(*[F.bit_or(F.col("bits")[k]) for k in range(words)]).cast("array<bigint>")
    nothing = F.lit(None).cast(inner.schema["src"].dataType)
    free = heads.where("needed IS NULL").select("label", F.lit(0).alias("level"), F.col("w").alias("value"), nothing.alias("previous"), "bits")
    settled, met, parts = stage(free, "order"), None, []
    while not settled.isEmpty():
        parts.append(settled)
        if len(parts) >= MERGED:
            parts = [stage(_union(parts), "order")]
        came = into.join(settled.select(F.col("label").alias("at"), "level", "value", "bits"), "at")
        total = (F.col("value") + F.col("gain")).cast(kind)
        # Of equal values the smallest label: the least of (-value, label).
        news = came.select(F.col("dst").alias("label"), (F.col("level") + F.col("hops") + 1).alias("level"), total.alias("value"), F.struct((-total).alias("minus"), F.col("src").alias("label")).alias("ahead"), _either("bits", "on_way").alias("bits"), F.lit(1).cast("long").alias("got"))
        if met is not None:
            news = news.unionByName(met.where("got < needed").select(*news.columns))
        joined = news.groupBy("label").agg(F.max("level").alias("level"), folded.alias("value"), F.min("ahead").alias("ahead"), unite.alias("bits"), F.sum("got").alias("got"))
        met = stage(joined.join(heads.select("label", "needed", "w", F.col("bits").alias("own_bits")), "label"), "order-met")
        settled = met.where("got = needed").select("label", F.col("level").cast("int").alias("level"), (F.col("value") + F.col("w")).cast(kind).alias("value"), F.col("ahead.label").alias("previous"), _either("own_bits", "bits").alias("bits"))
    done = _union(parts) if parts else settled
    if done.count() < heads.count():
        raise GraphError("the graph has a cycle")
    behind = done.select(F.col("label").alias("at"), "level", "value", F.col("bits").alias("behind"))
    chains = short.join(behind, "at").select("label", (F.col("level") + F.col("hops")).cast("int").alias("level"), (F.col("value") + F.col("gain")).cast(kind).alias("value"), F.col("near").alias("previous"), _either("behind", "bits").alias("bits"))
    return done.unionByName(chains)


def path_counts(edges: DataFrame, starts: DataFrame, direction: str = "rdeps") -> DataFrame:
    """(label, paths decimal(38,0)): along how many paths a label is reached. The bag of transitive neighbours, counted
    rather than listed: it grows exponentially with diamonds. Cycles raise GraphError, as do counts beyond 38 digits
    Spark's error for decimals."""
    steps = _stepping(edges, direction).select(F.col("here").alias("src"), F.col("there").alias("dst")).distinct()
    met = reachable(edges, starts, direction)
    begin = starts.groupBy("label").agg(F.count("*").cast("decimal(38,0)").alias("begin"))
    nodes = stage(met.unionByName(starts.select("label")).distinct().join(begin, "label", "left"), "path-nodes")
    ways = F.coalesce("begin", F.lit(0)).cast("decimal(38,0)")
    found = accumulate(nodes.select("label", ways.alias("w")), steps, "sum").select("label", "value")
    return found.join(nodes.select("label", ways.alias("own")), "label").select("label", (F.col("value") - F.col("own")).cast("decimal(38,0)").alias("paths")).where("paths > 0")


def transitive(edges: DataFrame, label, direction: str, distinct: bool = True) -> DataFrame:
    """Transitive neighbours of a label, sorted; with ``distinct=False`` one row per path."""
    starts = edges.sparkSession.createDataFrame([(label,)], edges.select(F.col("src").alias("label")).schema)
    if distinct:
        return reachable(edges, starts, direction).orderBy("label")
    counted = stage(path_counts(edges, starts, direction), "paths")
    total = counted.agg(F.sum("paths")).first()[0] or 0
    if total > MOST_LISTED:
        raise GraphError(f"{total} paths are too many to list; path_counts counts them")
    return counted.select(F.explode(F.array_repeat("label", F.col("paths").cast("int"))).alias("label")).orderBy("label")


def _peel(nodes: DataFrame, edges: DataFrame):
    """Yields the levels (nodes all of whose dependencies are in earlier levels), then the edges that are left."""
    left, remaining = stage(nodes.select("label").distinct(), "peel-nodes"), stage(edges, "peel-edges")
    while True:
        free = stage(left.join(remaining.select(F.col("dst").alias("label")).distinct(), "label", "left_anti"), "peel-level")
        if free.isEmpty():
            break
        yield free
        left = stage(left.join(free, "label", "left_anti"), "peel-nodes")
        remaining = stage(remaining.join(free.select(F.col("label").alias("src")), "src", "left_anti"), "peel-edges")
    yield remaining


def _labels(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("label")).union(edges.select(F.col("dst").alias("label"))).distinct()


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, level): 0 without dependencies, else one more than the highest of them. A topological order is any
    order by level. Cycles raise GraphError."""
    return accumulate(nodes.select("label", F.lit(0).cast("long").alias("w")).distinct(), edges).select("label", "level")


def longest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (label, weight) -> (label, level, total, previous): the weight of the heaviest path that ends in each node, and
    the node before it on that path; of equal ones the smallest label. Cycles raise GraphError."""
    return accumulate(nodes.select("label", F.col("weight").cast("long").alias("w")), edges).select("label", "level", F.col("value").alias("total"), "previous")


def _jumps(steps: DataFrame):
    """(here, there), one step from every node at most -> the same for 1, 2, 4, ... steps, until none is left or the
    nodes are used up."""
    steps = stage(steps, "jumps")
    for _ in range(max(1, steps.count()).bit_length()):
        yield steps
        further = steps.select(F.col("here").alias("_here"), F.col("there").alias("here")).join(steps, "here").select(F.col("_here").alias("here"), "there")
        steps = stage(further, "jumps")
        if steps.isEmpty():
            return


def followed(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(label, place): where one leads to that follows ``steps`` (here, there) from ``start`` (label), by pointer
    doubling: the rounds follow the logarithm of the way. In a ring each label has its first place."""
    seen, size = stage(start.select("label", F.lit(0).cast("long").alias("place")), "followed"), 1
    for jump in _jumps(steps):
        more = jump.join(seen.withColumnRenamed("label", "here"), "here").select(F.col("there").alias("label"), (F.col("place") + size).alias("place"))
        seen = stage(seen.unionByName(more).groupBy("label").agg(F.min("place").alias("place")), "followed")
        size *= 2
    return seen


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (label, node_type, execution_millis, cache_millis) -> one row: path, exec_millis, cache_millis. Aliases
    and resources weigh nothing; ties go to the smallest label."""
    target = F.col("node_type") == "target"
    part = lambda c: F.when(target, F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    weighed = nodes.select("label", part("execution_millis").alias("exec"), part("cache_millis").alias("cache")).withColumn("weight", F.col("exec") + F.col("cache"))
    best = stage(longest_paths(weighed, edges), "longest")
    back = best.where("previous IS NOT NULL").select(F.col("label").alias("here"), F.col("previous").alias("there"))
    on_path = followed(back, best.orderBy(F.col("total").desc(), "label").limit(1).select("label")).join(weighed, "label")
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("place"), "label"))), lambda x: x["label"])
    row = on_path.agg(path.alias("path"), F.sum("exec").cast("long").alias("exec_millis"), F.sum("cache").cast("long").alias("cache_millis"))
    return row.where(F.size("path") > 0)


def find_cycle(edges: DataFrame) -> DataFrame:
    """(place, label): one cycle, closed by repeating its first label; empty if there is none. From the smallest label on
    any cycle's core it follows the smallest dependants."""
    rest = edges
    for back in (False, True):  # nodes in front of all cycles go, then those behind
        turned = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else rest
        *_, rest = _peel(_labels(turned), turned)
    # Both peelings done: every node left has a next one (edges are turned around now).
    after = stage(rest.groupBy(F.col("dst").alias("here")).agg(F.min("src").alias("there")), "cycle")
    walk = followed(after, after.orderBy("here").limit(1).select(F.col("here").alias("label")))
    # The way never ends, so its last new label leads back to where the ring begins.
    last = walk.orderBy(F.desc("place")).limit(1).select(F.col("label").alias("here"), F.col("place").alias("until"))
    first = last.join(after, "here").select(F.col("there").alias("label"), "until").join(walk, "label").select(F.col("label").alias("again"), F.col("place").alias("since"), "until")
    ring = walk.join(F.broadcast(first), F.col("place") >= F.col("since"))
    return ring.select((F.col("place") - F.col("since")).alias("place"), "label").unionByName(first.select((F.col("until") - F.col("since") + 1).alias("place"), F.col("again").alias("label"))).orderBy("place")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    labels = nodes.select("label").distinct()
    return edges.join(labels.withColumnRenamed("label", "src"), "src", "left_semi").join(labels.withColumnRenamed("label", "dst"), "dst", "left_semi").select("src", "dst")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on which no other of the nodes depends."""
    inner = induced(nodes, edges)
    return nodes.select("label").join(inner.select(F.col("src").alias("label")), "label", "left_anti")


def resolve_aliases(nodes: DataFrame) -> DataFrame:
    """(label, target): the target behind a chain of aliases; null if it ends in a resource, in nothing or in a ring.

    Chains are halved each round, so the rounds follow the logarithm of the longest chain, or with rings that of the number
    of aliases. Aliases are shuffled, never broadcast.
    """
    kinds = nodes.select(F.col("label").alias("at"), "node_type")
    hops = stage(nodes.where("node_type = 'alias'").select("label", F.col("actual").alias("at")), "alias")
    for _ in range(max(1, hops.count()).bit_length()):
        onward = hops.select(F.col("label").alias("at"), F.col("at").alias("beyond"))
        joined = hops.join(onward.hint("merge"), "at", "left").select("label", F.coalesce("beyond", "at").alias("at"), F.col("beyond").isNotNull().alias("went"))
        new = stage(joined, "alias")
        unstage(hops)
        hops = new.drop("went")
        hops.staged_at = new.staged_at
        if new.where("went").isEmpty():
            break
    ends = nodes.where("node_type <> 'alias'").select("label", F.col("label").alias("at")).unionByName(hops)
    return ends.join(kinds.hint("merge"), "at", "left").select("label", F.when(F.col("node_type") == "target", F.col("at")).alias("target"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per node with its sorted dependencies: (label, json)."""
    deps = edges.groupBy(F.col("dst").alias("label")).agg(F.array_sort(F.collect_set("src")).alias("dependencies"))
    full = nodes.select("label").join(deps, "label", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))
    return full.select("label", F.to_json(F.struct("label", "dependencies")).alias("json"))

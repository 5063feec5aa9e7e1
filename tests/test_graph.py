"""Selection, graph walks, changes and views on small workspaces."""

import inspect
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.workspaces import diamond, node, querying, table
from tracewright.functions.labels import LabelError, Pattern, completions, parse_label
from tracewright.operators import changes, graph, render, selection


def labels(df):
    return [r.label for r in df.collect()]


@pytest.fixture(scope="module")
def workspace(spark):
    nodes = table(spark, querying()).cache()
    return nodes, graph.edges_of(nodes).cache()


def files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file string")


def test_list(workspace):
    nodes, _ = workspace
    assert labels(selection.list_nodes(nodes, tags=["tag1"])) == ["//package_1:foo", "//package_2:package_2"]
    assert labels(selection.list_nodes(nodes, exclude_tags=["tag1"])) == ["//:bin", "//package_1:bar", "//package_1:foo_test"]
    assert labels(selection.list_nodes(nodes, kind="test")) == ["//package_1:foo_test"]
    assert labels(selection.list_nodes(nodes, kind="bin_output")) == ["//:bin"]
    assert labels(selection.list_nodes(nodes, patterns=[Pattern.parse(":all", "package_1")], kind="no_test")) == ["//package_1:bar", "//package_1:foo"]
    with pytest.raises(ValueError, match="both"):
        selection.list_nodes(nodes, tags=["a"], exclude_tags=["a"])


def test_neighbours(workspace):
    _, edges = workspace
    assert labels(graph.direct(edges, "//package_2:package_2", "deps")) == ["//package_1:foo"]
    assert labels(graph.transitive(edges, "//package_2:package_2", "deps")) == ["//package_1:bar", "//package_1:foo"]
    assert labels(graph.direct(edges, "//package_1:bar", "rdeps")) == ["//package_1:foo"]
    assert labels(graph.transitive(edges, "//package_1:bar", "rdeps")) == ["//package_1:foo", "//package_1:foo_test", "//package_2:package_2"]
    assert labels(graph.transitive(edges, "//:bin", "rdeps")) == []


def test_bag_of_transitive_dependencies(spark):
    edges = graph.edges_of(table(spark, diamond()))
    assert labels(graph.transitive(edges, "//package_2:package_3", "deps", distinct=False)) == ["//package_1:bar"] * 2 + ["//package_1:foo"] * 2 + ["//package_2:package_2"]


def test_owners_and_changes(spark, workspace):
    nodes, edges = workspace
    assert labels(changes.owners(nodes, files(spark, "package_1/source.txt"))) == ["//package_1:bar", "//package_1:foo"]
    assert labels(changes.changes(nodes, edges, files(spark, "package_1/source_2.txt"))) == ["//package_1:bar"]
    after = changes.changes(nodes, edges, files(spark, "package_1/source_2.txt"), dependents="transitive", kind="no_test")
    assert labels(after) == ["//package_1:bar", "//package_1:foo", "//package_2:package_2"]
    assert labels(changes.consumer_roots(nodes, edges, files(spark, "package_1/source_2.txt"))) == ["//package_1:foo_test", "//package_2:package_2"]


def test_explanations(spark, workspace):
    nodes, edges = workspace
    changed = files(spark, "BUILD.json", "bin.sh", "package_1/source_2.txt")
    index = changes.affected_index(nodes, edges, changed)
    assert shown(render.explain_consumers(index, changes.affected_edges(nodes, edges, changed))) == [
        "//:bin", "├─↑ BUILD.json", "╰─↑ bin.sh", "//package_1:foo_test", "╰─↑ //package_1:foo", "    ╰─↑ //package_1:bar", "        ╰─↑ package_1/source_2.txt",
        "//package_2:package_2", "╰─↑ //package_1:foo", "    ╰─↑ //package_1:bar", "        ╰─↑ package_1/source_2.txt",
    ]
    assert shown(render.explain_files(changes.touched(nodes, changed), edges))[-5:] == [
        "package_1/source_2.txt", "╰─↓ //package_1:bar", "    ╰─↓ //package_1:foo", "        ├─↓ //package_1:foo_test", "        ╰─↓ //package_2:package_2",
    ]
    assert shown(render.explain_files(changes.touched(nodes, changed), edges, show_files=False))[0] == "//:bin"


def test_dependency_trees(spark):
    nodes = table(spark, [n for n in diamond() if not n["name"].startswith("bin")])
    assert shown(render.dependency_trees(nodes, graph.edges_of(nodes))) == [
        "//package_1:foo_test", "╰── //package_1:foo", "    ╰── //package_1:bar", "//package_2:package_3", "├── //package_1:foo", "│   ╰── //package_1:bar",
        "╰── //package_2:package_2", "    ╰── //package_1:foo", "        ╰── //package_1:bar", "//package_2:package_4",
    ]
    deps = {}
    for src, dst in sorted(tuple(r) for r in graph.edges_of(nodes).collect()):
        deps.setdefault(dst, []).append(src)
    document = "\n".join(shown(render.graph_document(nodes, graph.edges_of(nodes))))
    assert document == json.dumps({"nodes": sorted(r.label for r in nodes.collect()), "edges": dict(sorted(deps.items()))}, indent=2)
    chart = shown(render.mermaid(nodes, graph.edges_of(nodes)))
    assert chart[:2] == ["flowchart TD", '    n0["//package_1:bar"]'] and "    n1 --> n0" in chart and len(chart) == 1 + nodes.count() + graph.edges_of(nodes).count()


def shown(lines):
    rows = sorted(lines.collect())
    assert [r.place for r in rows] == list(range(len(rows)))
    return [r.line for r in rows]


def test_trees_too_large_to_show_and_rings(spark, tmp_path):
    diamonds = [(f"n{k:02d}", f"{side}{k:02d}") for k in range(14) for side in "ab"] + [(f"{side}{k:02d}", f"n{k + 1:02d}") for k in range(14) for side in "ab"]
    for edges in (diamonds, [("x", "y"), ("y", "x")]):
        table = spark.createDataFrame(edges, "src string, dst string")
        nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e} | {"alone"})], "label string")
        with pytest.raises(render.TooLarge):
            render.dependency_trees(nodes, table, most=2_000)
    few = spark.createDataFrame(diamonds[:8] + diamonds[28:32], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in diamonds[:8] for x in e})], "label string")
    lines = render.dependency_trees(nodes, few)
    render.write_lines(lines, f"{tmp_path}/tree")
    assert [r.value for r in spark.read.text(f"{tmp_path}/tree").collect()] == shown(lines)


def test_trees_of_any_size(spark, monkeypatch):
    diamonds = [(f"n{k:02d}", f"{side}{k:02d}") for k in range(8) for side in "ab"] + [(f"{side}{k:02d}", f"n{k + 1:02d}") for k in range(8) for side in "ab"]
    nodes, edges = spark.createDataFrame([(x,) for x in sorted({x for e in diamonds for x in e})], "label string"), spark.createDataFrame(diamonds, "src string, dst string")
    needs = {}
    for src, dst in sorted(diamonds):
        needs.setdefault(dst, []).append(src)

    def walk(label, indent):
        kids = needs.get(label, [])
        for k, kid in enumerate(kids):
            last = k == len(kids) - 1
            yield f"{indent}{'╰' if last else '├'}── {kid}"
            yield from walk(kid, indent + ("    " if last else "│   "))

    want = ["n08", *walk("n08", "")]
    assert len(want) == 1 + 4 * (2**8 - 1)
    for held in (render.HELD, 0):  # trees that are repeated whole, held by every task or shuffled
        monkeypatch.setattr(render, "HELD", held)
        assert shown(render.dependency_trees(nodes, edges)) == want
    assert inspect.signature(render.dependency_trees).parameters["most"].default is None  # nothing is refused unless asked for


def test_alias_rounds_follow_the_chains(spark, monkeypatch):
    rows = [("t", "target", None), *((f"a{k}", "alias", "t" if k < 100 else f"a{k - 100}") for k in range(300)), ("x", "alias", "y"), ("y", "alias", "x")]
    staged, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label: staged.append(label) or stage(df, label))
    straight = spark.createDataFrame(rows[:-2], "label string, node_type string, actual string")
    assert {r.target for r in graph.resolve_aliases(straight).collect()} == {"t"} and len(staged) == 4  # chains of three, not 300 aliases
    ring = {r.label: r.target for r in graph.resolve_aliases(spark.createDataFrame(rows, straight.schema)).collect()}
    assert ring["x"] is None and ring["y"] is None and ring["a299"] == "t"


def chain(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_critical_path(spark):
    rows = [("a", "target", 1_000, 0), ("b", "target", 3_000, 0), ("c", "target", 1_000, 500), ("d", "target", 1_000, 500), ("r", "resource", 9_000, 9_000)]
    nodes = spark.createDataFrame(rows, "label string, node_type string, execution_millis long, cache_millis long")
    edges = chain(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("r", "a"))
    best = graph.critical_path(nodes, edges).first()
    assert (list(best.path)[-3:], best.exec_millis, best.cache_millis) == (["a", "b", "d"], 5_000, 500)


def test_walks_against_brute_force(spark):
    rng = random.Random(1)
    n = 40
    pairs = sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(90)) if a < b})
    nodes = spark.createDataFrame([(f"n{k:02d}", k % 5 + 1) for k in range(n)], "label string, weight long")
    edges = chain(spark, *pairs)
    level, total, paths = {}, {}, {}
    for k in range(n):
        into = [a for a, b in pairs if b == f"n{k:02d}"]
        level[f"n{k:02d}"] = max((level[a] + 1 for a in into), default=0)
        total[f"n{k:02d}"] = k % 5 + 1 + max((total[a] for a in into), default=0)
    for k in range(n):
        paths[f"n{k:02d}"] = sum((1 if a == "n00" else 0) + paths.get(a, 0) for a, b in pairs if b == f"n{k:02d}")
    assert {r.label: r.level for r in graph.levels(nodes, edges).collect()} == level
    assert {r.label: r.total for r in graph.longest_paths(nodes, edges).collect()} == total
    start = spark.createDataFrame([("n00",)], "label string")
    assert {r.label: r.paths for r in graph.path_counts(edges, start).collect()} == {k: v for k, v in paths.items() if v}
    assert {r.label for r in graph.reachable(edges, start).collect()} == {k for k, v in paths.items() if v}


def test_many_paths_are_counted(spark):
    """Sixteen layers of 17 nodes each, all linked: counts beyond a long, and no listing of them."""
    layers = [[f"l{k:02d}x{i}" for i in range(17)] for k in range(17)]
    edges = chain(spark, *((a, b) for one, two in zip(layers, layers[1:]) for a in one for b in two))
    got = {r.label: r.paths for r in graph.path_counts(edges, spark.createDataFrame([("l00x0",)], "label string")).collect()}
    assert got == {x: 17**k for k, layer in enumerate(layers[1:]) for x in layer} and max(got.values()) > 2**61
    with pytest.raises(graph.GraphError, match="too many"):
        graph.transitive(edges, "l00x0", "rdeps", distinct=False)


def test_long_ways_take_few_rounds(spark):
    steps = spark.createDataFrame([(k, k + 1) for k in range(2_000)], "here long, there long")
    got = graph.followed(steps, spark.createDataFrame([(0,)], "label long")).collect()
    assert sorted((r.label, r.place) for r in got) == [(k, k) for k in range(2_001)]


def test_cycles(spark):
    edges = chain(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("x", "y"))
    assert [(r.place, r.label) for r in graph.find_cycle(edges).collect()] == [(0, "b"), (1, "c"), (2, "d"), (3, "b")]
    assert graph.find_cycle(edges.where("src <> 'd'")).count() == 0
    ring = chain(spark, *((f"n{k:03d}", f"n{(k + 1) % 100:03d}") for k in range(100)), ("n005", "n005x"), ("a", "n050"))
    assert labels(graph.find_cycle(ring)) == [f"n{k % 100:03d}" for k in range(101)]
    assert labels(graph.reachable(edges, spark.createDataFrame([("b",)], "label string")).orderBy("label")) == ["b", "c", "d", "e"]
    with pytest.raises(graph.GraphError):
        graph.levels(spark.createDataFrame([(x,) for x in "abcde"], "label string"), edges)
    assert labels(graph.self_loops(chain(spark, ("a", "a"), ("a", "b")))) == ["a"]


def test_aliases(spark):
    nodes = table(spark, [node("//:t"), node("//:a", "alias", actual="//:b"), node("//:b", "alias", actual="//:c"), node("//:c", "alias", actual="//:t"), node("//:r", "resource"), node("//:x", "alias", actual="//:r"), node("//:y", "alias", actual="//:z"), node("//:z", "alias", actual="//:y"), node("//:q", "alias", actual="//:gone")])
    got = {r.label: r.target for r in graph.resolve_aliases(nodes).collect()}
    assert got == {"//:t": "//:t", "//:a": "//:t", "//:b": "//:t", "//:c": "//:t", "//:r": None, "//:x": None, "//:y": None, "//:z": None, "//:q": None}
    assert [(r.label, r.dependency) for r in graph.unresolved(nodes, graph.edges_of(nodes)).collect()] == [("//:q", "//:gone")]


def test_build_selection(spark):
    nodes = table(spark, [node("//:a", platforms=["darwin/arm64"]), node("//:b", dependencies=["//:a"]), node("//:c", platforms=["linux/amd64"]), node("//:d", platforms=["darwin/arm64"])])
    got = {r.label: (r.chosen, r.platform_error) for r in selection.build_selection(nodes, graph.edges_of(nodes), "linux/amd64", patterns=[Pattern.parse("//...")]).collect()}
    assert got == {"//:a": (False, True), "//:b": (True, False), "//:c": (True, False)}
    assert tuple(selection.selection_counts(nodes, "linux/amd64").first()) == (2, 2)
    assert labels(selection.list_nodes(nodes, host="linux/amd64")) == ["//:b", "//:c"]


def test_platform_errors_name_the_chain(spark):
    nodes = table(spark, [node("//:mac", platforms=["darwin/arm64"]), node("//:lib", dependencies=["//:mac"]), node("//:app", dependencies=["//:lib"]), node("//:other", dependencies=["//:ok"]), node("//:ok")])
    edges = graph.edges_of(nodes)
    row = selection.platform_error(nodes, edges, "linux/amd64", patterns=[Pattern.parse("//:app")]).first()
    assert list(row.chain) == ["//:app", "//:lib", "//:mac"]
    assert row.message == "could not select node //:app because it depends on //:lib -> //:mac, which does not match the platform linux/amd64"
    assert selection.platform_error(nodes, edges, "linux/amd64", patterns=[Pattern.parse("//:other")]).count() == 0


@pytest.mark.parametrize(
    ("pattern", "label", "fits"),
    [
        ("//foo/...", "//foo:x", True), ("//foo/...", "//foo/bar:x", True), ("//foo/...", "//foobar:x", False), ("//...", "//any/where:x", True), ("//foo/...:t", "//foo/a:t", True), ("//foo/...:t", "//foo/a:u", False),
        ("//foo:t", "//foo:t", True), ("//foo", "//foo:foo", True), ("//foo", "//foo:t", False), ("//foo:all", "//foo:t", True), ("//foo:...", "//foo/a:t", False), (":t", "//cur:t", True),
    ],
)
def test_patterns(spark, pattern, label, fits):
    package, name = parse_label(label)
    row = spark.range(1).select(Pattern.parse(pattern, "cur").matches(F.lit(package), F.lit(name)).alias("m")).first()
    assert row.m == fits


@pytest.mark.parametrize("bad", ["foo", "//foo/...x", "//foo:b!d", "//a/.../b"])
def test_bad_patterns(bad):
    with pytest.raises(LabelError):
        Pattern.parse(bad)


def test_labels():
    assert parse_label("//a/b") == ("a/b", "b") and parse_label(":x", "p") == ("p", "x") and parse_label("//:r") == ("", "r")
    for bad in ("x", "//a:b c", "//a:...", "//"):
        with pytest.raises(LabelError):
            parse_label(bad)


def test_completions(spark):
    rows = spark.createDataFrame([("", "root"), ("pack", "x"), ("pack/sub", "y"), ("pack/sub/deep", "z"), ("other", "w")], "package string, name string")
    shown = lambda typed, current="": [r.completion for r in completions(rows, typed, current).collect()]
    assert shown("//pa") == ["//pack", "//pack/", "//pack/..."] or shown("//pa") == ["//pack/", "//pack/..."]
    assert shown("//pack:") == ["//pack:x"] and shown(":r") == [":root"]
    assert "//pack/sub/" in shown("//pack/") and "//pack:x" in shown("//pack/")


def test_walks_work_out_their_tables_once(spark, workspace):
    """What is read several times is staged: no plan of a result holds the search for touched targets, or the union of a
    walk's rounds, again."""
    nodes, edges = workspace
    roots = changes.consumer_roots(nodes, edges, files(spark, "package_1/source_2.txt"))
    assert labels(roots) == ["//package_1:foo_test", "//package_2:package_2"]
    plan = roots._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # of definitions and inputs, of rounds
    counted = graph.path_counts(edges, spark.createDataFrame([("//package_1:bar",)], "label string"))
    assert "reach-" not in " ".join(counted.inputFiles()) and {r.label: int(r.paths) for r in counted.collect()} == {"//package_1:foo": 1, "//package_1:foo_test": 1, "//package_2:package_2": 1}

"""Constraints, conflicts, incremental builds and scalar functions."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.workspaces import node, table
from tracewright.functions import scalars as X
from tracewright.operators import checks, graph, incremental


def file(name, kind="file"):
    return {"type": kind, "identifier": name}


def found(df):
    return {(r.check, r.label, r.detail) for r in df.collect()}


def test_violations(spark):
    nodes = table(spark, [
        node("//p:abs", inputs=["/etc/x"]), node("//p:up", inputs=["a/../../x", "a/../b"]), node("//p:out", inputs=["i"], outputs=[file("../../x"), file("../ok"), file("/abs", "dir")]),
        node("//p:no_test", command="", inputs=["i"]), node("//p:idle"), node("//p:push", inputs=["i"], outputs=[file("img", "oci")], oci_push={"img": ["r"], "other": ["r"]}),
        node("//p:user", inputs=["i"], dependencies=["//p:alias"]), node("//p:alias", "alias", actual="//p:no_test"), node("//p:only", inputs=["i"], tags=["testonly"]),
        node("//p:lib", inputs=["i"], dependencies=["//p:only"]), node("//p:lib_test", inputs=["i"], dependencies=["//p:only", "//p:no_test"]), node("//p:res", "resource", dependencies=["//p:no_test"]),
        node("//p:lost", inputs=["i"], dependencies=["//p:gone"]), node("//p:twice", inputs=["i"]), node("//p:twice", "resource"),
    ])
    edges = graph.edges_of(nodes)
    got = found(checks.violations(nodes, edges))
    assert got == {
        ("absolute_input", "//p:abs", "/etc/x"), ("escaping_input", "//p:up", "a/../../x"), ("escaping_output", "//p:out", "../../x"), ("absolute_output", "//p:out", "/abs"), ("test_without_command", "//p:no_test", "//p:no_test"),
        ("runs_once", "//p:idle", "//p:idle"), ("push_without_image", "//p:push", "other"), ("depends_on_test", "//p:user", "//p:no_test"), ("depends_on_test", "//p:res", "//p:no_test"),
        ("depends_on_testonly", "//p:lib", "//p:only"), ("missing_dependency", "//p:lost", "//p:gone"), ("duplicate_label", "//p:twice", "2"),
    }


def test_output_conflicts(spark):
    nodes = table(spark, [
        node("//a:one", outputs=[file("x")]), node("//a:two", outputs=[file("./x")]), node("//a:dir", outputs=[file("d", "dir")]), node("//a:in", outputs=[file("d/e/f")]), node("//a/d:sub", outputs=[file("g", "dir")]),
        node("//a:after", outputs=[file("x")], dependencies=["//a:one", "//a:two"]), node("//b:img", outputs=[file("i", "oci")]), node("//c:img", outputs=[file("i", "oci")]), node("//c:i", outputs=[file("../i")]),
    ])
    got = [(r.kind, r.a, r.b) for r in checks.output_conflicts(nodes, graph.edges_of(nodes)).collect()]
    assert sorted(got) == [("image", "//b:img", "//c:img"), ("inside_folder", "//a/d:sub", "//a:dir"), ("inside_folder", "//a:dir", "//a:in"), ("same_path", "//a:one", "//a:two")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_definition_hash(spark):
    nodes = table(spark, [node("//p:t", command="c", inputs=["b", "a"], outputs=[file("o"), file("i", "oci")], bin_output=file("z"), fingerprint={"k": "v", "a": "b"})])
    one = lambda **o: nodes.select(incremental.definition_hash(F.array(F.lit("h2"), F.lit("h1")), "linux/amd64", **o)).first()[0]
    assert one() == sha("//p:t" + "c" + "a,b" + "o,oci::i,z" + "h1,h2" + "a=b,k=v" + "linux/amd64" + "fs")
    assert len({one(), one(extra=["x"]), one(platform_tags=["gpu"]), one(oci_backend="registry")}) == 4


def test_early_cutoff(spark):
    nodes = table(spark, [node("//:lib", inputs=["f"]), node("//:mid", inputs=["g"], dependencies=["//:lib"]), node("//:app", dependencies=["//:mid"])])
    edges = graph.edges_of(nodes)
    contents = lambda x: spark.createDataFrame([("//:lib", x), ("//:mid", "m")], "label string, content_hash string")
    outs = lambda x: spark.createDataFrame([("//:lib", x), ("//:mid", "mo")], "label string, output_hash string")
    cache = spark.createDataFrame([], "change_hash string, output_hash string")
    first = incremental.plan_builds(nodes, edges, contents("1"), cache, outs("o1"))
    assert not [r for r in first.collect() if r.hit]
    cache = first.select("change_hash", "output_hash")
    hits = lambda *a, **k: {r.label[3:]: r.hit for r in incremental.plan_builds(nodes, edges, *a, **k).collect()}
    assert hits(contents("1"), cache, outs("o1")) == {"lib": True, "mid": True, "app": True}
    assert hits(contents("2"), cache, outs("o1")) == {"lib": False, "mid": True, "app": True}  # the output stayed
    assert hits(contents("2"), cache, outs("o2")) == {"lib": False, "mid": False, "app": True}
    dirty = spark.createDataFrame([("//:mid",)], "label string")
    assert hits(contents("1"), cache, outs("o1"), tainted=dirty) == {"lib": True, "mid": False, "app": True}
    assert hits(contents("1"), cache, outs("o1"), enabled=False) == {"lib": False, "mid": False, "app": False}


def test_hashes_of_both_kinds(spark):
    """XXH3 of 128 bits beside SHA-256; a dependency without a hash and an unknown output type are errors."""
    nodes = table(spark, [node("//p:t", command="c", inputs=["b", "a"])])
    files = spark.createDataFrame([("p/a", b"1"), ("p/b", b"23")], "file string, content binary")
    assert incremental.content_hashes(nodes, files, "xxh3").first().content_hash == xxhash.xxh3_128_hexdigest(b"123")
    assert value(spark, X.list_hash(F.array(F.lit("b"), F.lit("a")), "xxh3")) == xxhash.xxh3_128_hexdigest("a,b")
    got = nodes.select(incremental.definition_hash(F.array().cast("array<string>"), "linux/amd64", algorithm="xxh3")).first()[0]
    assert got == xxhash.xxh3_128_hexdigest("//p:tca,blinux/amd64")
    with pytest.raises(ValueError, match="md5"):
        X.text_hash(F.lit("x"), "md5")
    edges = spark.createDataFrame([("//p:a", "//p:t")], "src string, dst string")
    with pytest.raises(Exception, match="has no output hash"):
        incremental.dependency_hashes(edges, spark.createDataFrame([("//p:a", None)], "label string, output_hash string")).collect()
    with pytest.raises(Exception, match="unknown output type: tar"):
        value(spark, X.parsed_output(F.lit("tar::x")))


def test_many_contents_run_through_one_digest(spark):
    nodes = table(spark, [node(f"//p:t{k}", inputs=[f"f{i:03d}" for i in range(200)]) for k in range(3)])
    files = spark.createDataFrame([(f"p/f{i:03d}", bytes([i]) * 1_000) for i in range(200)], "file string, content binary")
    want = hashlib.sha256(b"".join(bytes([i]) * 1_000 for i in range(200))).hexdigest()
    assert [(r.label, r.content_hash) for r in incremental.content_hashes(nodes, files).orderBy("label").collect()] == [(f"//p:t{k}", want) for k in range(3)]


def test_failures_cancel_dependants(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "label string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    failed = spark.createDataFrame([("a",)], "label string")
    assert {r.label: r.is_success for r in incremental.completed(nodes, edges, failed).collect()} == {"a": False, "d": True}


def test_contents_and_stores(spark):
    nodes = table(spark, [node("//p:t", inputs=["b", "a", "gone"])])
    files = spark.createDataFrame([("p/a", b"1"), ("p/b", b"23")], "file string, content binary")
    assert incremental.content_hashes(nodes, files).first().content_hash == sha("123")
    results = spark.createDataFrame([("h", "old", 1), ("h", "new", 2)], "change_hash string, output_hash string, version int")
    assert incremental.latest_results(results, "version").first().output_hash == "new"
    store = incremental.taint(spark.createDataFrame([("a",)], "label string"), spark.createDataFrame([("b",), ("a",)], "label string"))
    assert {r.label for r in store.collect()} == {"a", "b"}
    assert [r.label for r in incremental.untaint(store, spark.createDataFrame([("a",)], "label string")).collect()] == ["b"]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("path", "clean"), [("a/./b", "a/b"), ("a/../b", "b"), ("../a", "../a"), ("", "."), ("a//b/", "a/b"), ("/a/../..", "/"), ("a", "a"), ("..", "..")])
def test_clean_path(spark, path, clean):
    assert value(spark, X.clean_path(F.lit(path))) == clean


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert [v(X.duration_text(F.lit(x))) for x in (0, 999, 1_000, 45_200)] == ["0ms", "999ms", "1.0s", "45.2s"]
    assert v(X.ellipsis(F.lit("x" * 80 + "\ny"))) == "x" * 67 + "..." and v(X.ellipsis(F.lit("short\nmore"))) == "short"
    assert v(X.first_bytes(F.lit("ä" * 600), 1_001)) == "ä" * 500
    assert v(X.sanitised(F.lit("a'b;c-d"))) == "abc-d"
    assert [X.age_millis(a) for a in ("2d", "3h")] == [172_800_000, 10_800_000]
    with pytest.raises(ValueError, match="7d"):
        X.age_millis("5m")
    assert v(X.listed(F.lit(""))) == [] and v(X.listed(F.lit("a,b"))) == ["a", "b"] and v(X.joined(F.array(F.lit("a"), F.lit("b")))) == "a,b"
    assert tuple(v(X.parsed_output(F.lit("oci::x:1")))) == ("oci", "x:1") and tuple(v(X.parsed_output(F.lit("f")))) == ("file", "f")
    assert v(X.megabytes(F.lit(1_572_864))) == "1.50"
    assert v(X.percent_text(F.lit(200 / 3))) == "66.7%" and v(X.whole_text(F.lit(2.0))) == "2"
    # ties, numbers beside a tie, and what Java's formatter rounds otherwise
    numbers = [0.0, 0.05, 0.25, 0.35, 0.5, 1.5, 2.5, 0.125, 0.375, 1.005, 2.675, 6.25, 18.75, 99.95, 99.96, -6.25, -0.04, 1e-300, 1e15 + 0.5, 1e22, *(100.0 * k / n for n in (3, 7, 16, 17, 80) for k in range(n + 1))]
    for places in (0, 1, 2):
        rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", X.fixed_text(F.col("x"), places).alias("t")).collect()
        assert [(r.x, r.t) for r in rows] == [(x, f"%.{places}f" % x) for x in numbers]
    assert v(X.percent_text(F.lit(6.25))) == "6.2%" and v(X.duration_text(F.lit(1_250))) == "1.2s"
    assert v(X.trace_hex(F.lit("123e4567-E89b-12d3-a456-426614174000"))) == "123e4567e89b12d3a456426614174000"


def folded(text, size):
    out, at = [0] * size, 0
    for c in text:
        out[at % size] ^= ord(c) & 255
        at += len(c.encode())
    return bytes(out).hex()


@pytest.mark.parametrize("text", ["trace-1", "trace-ä-1", "", "x" * 40])
def test_folded_identifiers(spark, text):
    assert value(spark, X.trace_hex(F.lit(text))) == folded(text, 16)
    assert value(spark, X.span_hex(F.lit(text), F.lit("root"))) == folded(text + "root", 8)


def test_resource_identity(spark):
    got = value(spark, X.resource_identity(F.lit("//:r"), F.lit("up"), F.lit(""), F.lit(None).cast("string"), F.lit("5s"), F.array(F.lit("//:d")), F.create_map(F.lit("B"), F.lit("2"), F.lit("A"), F.lit("1"))))
    parts = ["//:r", "up", "", "", "5s", "1", "//:d", "2", "A", "1", "B", "2"]
    assert got == sha("".join(f"{len(p)}:{p}" for p in parts))[:12]


def test_output_hash_and_errors(spark):
    rows = spark.createDataFrame([("a", ["d2", "d1"], "c1"), ("b", [], "c2"), ("c", None, "c3")], "label string, digests array<string>, change string")
    got = {r.label: r.h for r in rows.select("label", incremental.output_hash(F.col("digests"), F.col("change")).alias("h")).collect()}
    assert got == {"a": sha("d1,d2"), "b": "c2", "c": "c3"}
    done = spark.createDataFrame([("x", True, None, "CACHE_HIT"), ("z", False, "boom", None), ("y", False, "bang", None)], "label string, is_success boolean, err string, cache_result string")
    assert [tuple(r) for r in incremental.errors(done).collect()] == [("y", "bang"), ("z", "boom")]
    assert tuple(incremental.completion_counts(done).first()) == (1, 1, 2)


def test_tools_and_tags(spark):
    nodes = table(spark, [node("//p/q:q", bin_output=file("tool"), outputs=[file("o")], tags=["t"]), node("//p:x", dependencies=["//p/q:q", "//p:y"]), node("//p:y", outputs=[file("img", "oci")], tags=["t", "u"])])
    edges = graph.edges_of(nodes)
    got = {r.name: (r.binary, list(r.outputs)) for r in incremental.tool_paths(nodes, edges, "//p:x").collect()}
    assert got == {"//p/q:q": ("tool", ["o"]), "//p/q": ("tool", ["o"]), "//p:y": (None, ["oci::img"]), ":y": (None, ["oci::img"])}
    assert {r.tag: list(r.outputs) for r in incremental.outputs_by_tag(nodes, edges, "//p:x").collect()} == {"t": ["o", "oci::img"], "u": ["oci::img"]}

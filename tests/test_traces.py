"""The trace store, statistics, exports, definitions and streams."""

import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tests.workspaces import node, table
from tracewright.functions import scalars as X
from tracewright.operators import checks, incremental  # noqa: F401
from tracewright.operators import traces as T
from tracewright.plans import documented as D
from tracewright.schemas import BUILDS, SPANS
from tracewright.storage import stage
from tracewright.sources import definitions, files
from tracewright.sources import traces as store
from tracewright.streaming import ingest

DAY = 86_400_000
NOW = 20_000 * DAY + 5_000


def build(trace, start=NOW, **more):
    base = {f.name: "" if f.dataType.simpleString() == "string" else False if f.name == "is_ci" else 0 for f in BUILDS.fields}
    return base | {"trace_id": trace, "workspace": "test-workspace", "git_commit": "abc1234", "command": "build", "start_time_unix_millis": start, "total_duration_millis": 5_000, "total_targets": 10, "success_count": 8, "failure_count": 2, "cache_hit_count": 6} | more


def span(trace, label="//pkg:target", **more):
    base = {f.name: "" if f.dataType.simpleString() == "string" else False if f.name == "is_test" else 0 for f in SPANS.fields}
    return base | {"trace_id": trace, "label": label, "package": "pkg", "status": "SUCCESS", "cache_result": "CACHE_MISS", "start_time_unix_millis": NOW + 100, "end_time_unix_millis": NOW + 2_100, "total_duration_millis": 2_000, "command_duration_millis": 1_500, "hash_duration_millis": 50, "queue_wait_millis": 200} | more


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


def test_write_and_read_back(spark, tmp_path):
    root = str(tmp_path)
    b, s = frame(spark, [build("t1"), build("t2", NOW - 3 * DAY)], BUILDS), frame(spark, [span("t1"), span("t1", "//pkg:b")], SPANS)
    assert store.read_builds(spark, f"{root}/none").count() == 0
    store.write_traces(b, s, root)
    assert sorted(map(tuple, store.read_builds(spark, root).collect())) == sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, store.read_spans(spark, root).collect())) == sorted(map(tuple, s.collect()))
    store.write_json_lines(b, s, f"{root}/lines")
    lines = {x["trace_id"]: x for x in (json.loads(r.value) for r in spark.read.text(f"{root}/lines").collect())}
    assert lines["t2"]["spans"] is None and [x["label"] for x in lines["t1"]["spans"]] == ["//pkg:b", "//pkg:target"]
    b2, s2 = store.read_json_lines(spark, f"{root}/lines")
    assert b2.count() == 2 and s2.count() == 2
    other = f"{root}/other"
    assert store.pull(spark, root, other) == 2 and store.pull(spark, root, other) == 0
    assert store.read_spans(spark, other).count() == 2


def test_schema_drift(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("t1", "9.9")], "trace_id string, recorder string").write.parquet(f"{root}/builds/2024-01-01/")
    row = store.read_builds(spark, root, version_column="recorder").first()
    assert row.trace_id == "t1" and row.tool_version == "9.9" and row.command is None


def test_prune(spark, tmp_path):
    root = str(tmp_path)
    rows = [build("old", NOW - 2 * DAY), build("edge-old", NOW - 10), build("new", NOW + 10)]
    store.write_traces(frame(spark, rows, BUILDS), frame(spark, [span(r["trace_id"]) for r in rows], SPANS), root)
    assert store.prune(spark, root, NOW - 5 * DAY) == 0
    assert store.prune(spark, root, NOW) == 2
    assert [r.trace_id for r in store.read_builds(spark, root).collect()] == ["new"]
    assert [r.trace_id for r in store.read_spans(spark, root).collect()] == ["new"]


def test_list_and_find(spark):
    b = frame(spark, [build("trace-a", NOW), build("trace-b", NOW + 60_000), build("trace-c", NOW + 120_000, is_ci=True, failure_count=0)], BUILDS)
    ids = lambda df: [r.trace_id for r in df.collect()]
    assert ids(T.list_builds(b)) == ["trace-c", "trace-b", "trace-a"] and ids(T.list_builds(b, limit=1)) == ["trace-c"] and len(ids(T.list_builds(b, limit=0))) == 3
    assert ids(T.list_builds(b, failures=True)) == ["trace-b", "trace-a"] and ids(T.list_builds(b, since=NOW + 60_000)) == ["trace-c", "trace-b"]
    assert T.find_trace(b, "trace-a") == "trace-a"
    with pytest.raises(T.TraceError, match="ambiguous"):
        T.find_trace(b, "trace")
    with pytest.raises(T.TraceError, match="no trace"):
        T.find_trace(b, "x")
    view = T.list_view(T.list_builds(b, limit=1)).first()
    assert (view.duration, view.hit_band, view.commit, view.date) == ("5.0s", "warn", "abc1234", "2024-10-04")


def test_stats(spark):
    b = frame(spark, [build("1"), build("2", is_ci=True)], BUILDS)
    assert tuple(T.stats(b).first()) == (2, 5_000.0, 60.0, 4)
    assert tuple(T.stats(b, command="test").first()) == (0, None, None, 0)
    assert [T.stats(b, ci=c).first().build_count for c in (None, True, False)] == [2, 1, 1]


def test_bottlenecks(spark):
    b = frame(spark, [build("1"), build("2", NOW + 1), build("3", NOW + 2)], BUILDS)
    rows = [span(t, "//p:slow", queue_wait_millis=600, output_write_millis=700, output_load_millis=400, dep_load_millis=9_999) for t in "123"]
    rows += [span(t, "//p:hit", cache_result="CACHE_HIT", hash_duration_millis=300, status="FAILURE" if t == "1" else "SUCCESS", command_duration_millis=10) for t in "12"] + [span("1", "//p:once")]
    m = T.bottlenecks(frame(spark, rows, SPANS), T.recent(b)).orderBy("label").collect()
    assert [r.label for r in m] == ["//p:hit", "//p:slow"]
    hit, slow = m
    assert (slow.n, slow.frequency, slow.impact, slow.avg_io, slow.miss_rate, slow.failures) == (3, 1.0, 1_500.0, 1_100.0, 100.0, 0)
    assert (hit.n, hit.miss_rate, hit.failures, hit.impact) == (2, 0.0, 1, 10 * 2 / 3)
    df = spark.createDataFrame(m)
    shown = lambda c, **k: [r.label for r in T.bottleneck_category(df, c, **k).collect()]
    assert {c: shown(c) for c in T.CATEGORIES} == {"impact": ["//p:slow", "//p:hit"], "queue": ["//p:slow"], "io": ["//p:slow"], "hash": ["//p:hit"], "miss": ["//p:slow"], "flaky": ["//p:hit"]}
    assert shown("impact", per=1) == ["//p:slow"]
    assert T.overall_miss_rate(df).first()[0] == 50.0
    assert T.ranked_categories(df).where("category = 'impact'").count() == 2


def test_category_takes_the_first_by_impact(spark):
    df = spark.createDataFrame([(f"l{k:02d}", float(100 - k), 501.0 + k) for k in range(20)], "label string, impact double, avg_queue double")
    assert [r.label for r in T.bottleneck_category(df, "queue").collect()] == [f"l{k:02d}" for k in range(9, -1, -1)]


def test_otlp(spark):
    b, s = frame(spark, [build("123e4567-e89b-12d3-a456-426614174000", is_ci=True), build("no-spans", failure_count=0)], BUILDS), frame(spark, [span("123e4567-e89b-12d3-a456-426614174000", status="FAILURE")], SPANS)
    docs = {r.trace_id: json.loads(r.value) for r in T.as_otlp(b, s).collect()}
    spans = docs["123e4567-e89b-12d3-a456-426614174000"]["scopeSpans"][0]["spans"]
    root, child = spans
    assert root["traceId"] == "123e4567e89b12d3a456426614174000" and "parentSpanId" not in root and child["parentSpanId"] == root["spanId"]
    assert root["status"] == {"code": 2, "message": "2 targets failed"} and child["status"] == {"code": 2}
    assert root["startTimeUnixNano"] == f"{NOW}000000" and root["endTimeUnixNano"] == f"{NOW + 5_000}000000"
    assert {"key": "build.total_targets", "value": {"intValue": "10"}} in root["attributes"] and {"key": "build.is_ci", "value": {"boolValue": True}} in root["attributes"]
    assert len(docs["no-spans"]["scopeSpans"][0]["spans"]) == 1


def test_otlp_of_odd_values(spark, tmp_path):
    odd = ['a "b"', "back\\slash", "\n\t\x01\x1f\x7f", "é}\u2028\U0001f600", "", None, "plain"]
    builds = [build(f"t{k}", command=x, tool_version=x, requested_patterns=x, failure_count=k % 3 - 1, is_ci=None if k % 2 else True) for k, x in enumerate(odd)] + [build("x" * n, failure_count=None, start_time_unix_millis=None) for n in (9, 15, 33)]
    spans = [span(f"t{k}", x, change_hash=x, cache_result=x, is_test=None if k % 2 else False, status=x, queue_wait_millis=None if k % 2 else 7, end_time_unix_millis=None if k % 3 else NOW) for k, x in enumerate(odd)]
    b, s = frame(spark, builds, BUILDS), frame(spark, spans, SPANS)
    docs = {r.trace_id: json.loads(r.value) for r in T.as_otlp(b, s).collect()}
    store.write_otlp(b, s, f"{tmp_path}/lines")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect()]
    store.write_otlp_document(b, s, f"{tmp_path}/document")
    document = json.loads("".join(r.value for r in T.as_otlp_document(b, s).collect()))["resourceSpans"]
    assert sorted(map(json.dumps, lines)) == sorted(map(json.dumps, docs.values())) and document == [docs[t] for t in sorted(docs)]
    drop = lambda **x: {k: v for k, v in x.items() if v is not None}
    for k, x in enumerate(odd):
        scope = docs[f"t{k}"]["scopeSpans"][0]
        assert scope["scope"] == drop(name="tracewright", version=x) and docs[f"t{k}"]["resource"]["attributes"][1] == {"key": "service.version", "value": {"stringValue": x or ""}}
        top, child = scope["spans"]
        assert top.get("name") == (None if x is None else f"build {x}") and top["attributes"][6:] == [{"key": "build.is_ci", "value": {} if k % 2 else {"boolValue": True}}, {"key": "build.requested_patterns", "value": {"stringValue": x or ""}}]
        assert top["status"] == ({"code": 2, "message": "1 targets failed"} if k % 3 == 2 else {"code": 1})
        assert child == drop(
            traceId=top["traceId"], spanId=child["spanId"], parentSpanId=top["spanId"], name=x, kind=1, startTimeUnixNano=f"{NOW + 100}000000", endTimeUnixNano=None if k % 3 else f"{NOW}000000", attributes=child["attributes"], status={"code": 1},
        )
        assert child["attributes"][:3] == [{"key": "build.cache_result", "value": {"stringValue": x or ""}}, {"key": "build.change_hash", "value": {"stringValue": x or ""}}, {"key": "build.is_test", "value": {} if k % 2 else {"boolValue": False}}]
        assert child["attributes"][4] == {"key": "build.queue_wait_ms", "value": {} if k % 2 else {"intValue": "7"}}
    assert all("startTimeUnixNano" not in docs["x" * n]["scopeSpans"][0]["spans"][0] for n in (9, 15, 33))


@pytest.mark.parametrize("size", [8, 16])
def test_identifiers_of_any_length(spark, size):
    texts = ["".join(chr(33 + (7 * k + n) % 90) for k in range(n)) for n in range(6 * size)] + ["é" * n for n in (1, size, 3 * size)]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", X._folded(F.col("x"), size).alias("y")).collect()
    for x, y in got:
        folded, at = [0] * size, 0
        for c in x:
            folded[at % size] ^= ord(c) % 256
            at += len(c.encode())
        assert y == bytes(folded).hex()


def moved(df):
    """The exchanges of a plan but for broadcasts and those into one partition."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange " in line and "BroadcastExchange" not in line and "SinglePartition" not in line]


def test_otlp_exports_move_what_they_need_once(spark):
    b, s = frame(spark, [build("t")], BUILDS), frame(spark, [span("t")], SPANS)
    assert len(moved(T.as_otlp_document(b, s))) == 1
    for df in (T.otlp_pieces(b, s), T.as_otlp_document(b, s)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any("output_hash" in line for line in plan.splitlines() if "RDD" not in line)


def test_assemble(spark):
    nodes = table(spark, [node("//p:a", tags=["x", "y"]), node("//p:b"), node("//p:c"), node("//p:r", "resource")])
    phases = "queue_wait_millis long, hash_duration_millis long, cache_check_millis long, command_duration_millis long, output_write_millis long, output_load_millis long, cache_write_millis long, dep_load_millis long"
    done = spark.createDataFrame(
        [("//p:a", True, "CACHE_MISS", None, NOW, 50, 0, 0, 2_000, 100, 0, 0, 0), ("//p:b", True, "CACHE_HIT", None, NOW, 0, 0, 0, 0, 0, 50, 0, 0), ("//p:c", False, "CACHE_HIT", "boom", NOW, 1, 1, 1, 1, 1, 1, 1, 1), ("//p:r", True, None, None, NOW, 0, 0, 0, 0, 0, 0, 0, 0)],
        f"label string, is_success boolean, cache_result string, err string, start_time_unix_millis long, {phases}",
    )
    b, s = T.assemble(done, nodes, spark.createDataFrame([("t",)], "trace_id string"))
    assert (b.first().total_targets, b.first().success_count, b.first().failure_count, b.first().cache_hit_count) == (3, 2, 1, 1)
    got = {r.label: r for r in s.collect()}
    assert got["//p:a"].total_duration_millis == 2_150 and got["//p:a"].tags == "x,y" and got["//p:c"].cache_result == "CACHE_MISS" and got["//p:c"].status == "FAILURE"


def test_json_definitions_are_read_an_entry_at_a_time():
    """The slices of a file give what the whole file does, and don't hold its objects at once."""
    odd = ''' { "aliases" : [ {"name": "x", "actual": ":a" } ] , "targets": [1], "default_platforms": ["l"], "resources": null, "targets":[\n], "more": {"a": [1, 2]}, "targets" : [{"name": "a"},{"name": "b", "inputs": [",]}\\""]} ] }\n '''
    whole, parts = definitions.parse("p/BUILD.json", odd), list(definitions.slices("p/BUILD.json", odd))
    assert [n for part in parts for n in definitions.to_nodes("p/BUILD.json", part)] == definitions.to_nodes("p/BUILD.json", whole)
    assert list(definitions.slices("p/BUILD.json", "{}")) == []
    for wrong in ("", "{", "{]", '{"targets": [{}', '{"targets": [{},]}', '{"targets": [{} {}]}', '{"a": 1,}', '{"a" 1}', "{} x", "{1: 2}", '{"targets": [,]}', '{"a": 1 "b": 2}'):
        with pytest.raises(definitions.DefinitionError):
            definitions.parse("p/BUILD.json", wrong)
        with pytest.raises(definitions.DefinitionError):
            list(definitions.slices("p/BUILD.json", wrong))
    large = json.dumps({"targets": [{"name": f"n{k}", "command": "c", "inputs": ["a"]} for k in range(20_000)], "default_platforms": ["l"]})
    tracemalloc.start()
    n = 0
    for part in definitions.slices("p/BUILD.json", large):
        nodes = definitions.to_nodes("p/BUILD.json", part)
        assert len(nodes) <= definitions.SLICE and nodes[0]["platforms"] == ["l"]
        n += len(nodes)
    assert n == 20_000 and tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()


def test_definitions(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/BUILD.json").write_text(json.dumps({"targets": [{"name": "x", "command": "c", "dependencies": [":y", "//b"], "outputs": ["o", "oci::i"], "bin_output": "bin", "oci_push": {"i": "r:1"}}], "aliases": [{"name": "y", "actual": ":x"}], "default_platforms": ["linux/amd64"]}))
    (tmp_path / "b").mkdir()
    (tmp_path / "b/BUILD.yaml").write_text("targets:\n  - name: b\n    inputs: ['*.txt']\n    platforms: []\nresources:\n  - name: db\n    up: start\n    exports: {PORT: '1'}\n")
    (tmp_path / "Makefile").write_text("# @target\n# name: renamed\n# tags: [t]\nrule: dep\n\techo\nother:\n")
    (tmp_path / "b/run.target.sh").write_text("#!/bin/sh\n# @target\n# dependencies: [':b']\necho\n")
    (tmp_path / "b/notes.txt").write_text("no definition")
    got = {r.label: r for r in definitions.load(spark, str(tmp_path)).collect()}
    assert set(got) == {"//a:x", "//a:y", "//b:b", "//b:db", "//:renamed", "//b:run.target.sh"}
    x = got["//a:x"]
    assert list(x.dependencies) == ["//a:y", "//b:b"] and [tuple(o) for o in x.outputs] == [("file", "o"), ("oci", "i")] and x.oci_push == {"i": ["r:1"]} and list(x.platforms) == ["linux/amd64"] and x.source_file_path == "a/BUILD.json"
    assert list(got["//b:b"].platforms) == [] and got["//b:db"].exports == {"PORT": "1"} and got["//a:y"].actual == "//a:x"
    assert got["//:renamed"].command == "make rule" and list(got["//:renamed"].tags) == ["t"]
    script = got["//b:run.target.sh"]
    assert list(script.tags) == ["no-cache"] and list(script.inputs) == ["run.target.sh"] and script.bin_output.identifier == "run.target.sh" and list(script.dependencies) == ["//b:b"]
    with pytest.raises(definitions.DefinitionError):
        definitions.parse("p/BUILD.json", "{")
    with pytest.raises(definitions.DefinitionError):
        definitions.parse("Makefile", "# @target\n# a: 1\nno rule\n")


def test_files_and_globs(spark, tmp_path):
    for name in ("p/a.txt", "p/b.md", "p/q/c.txt", "p/q/r/d.txt", "e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * 100)
    keys = files.listing(spark, str(tmp_path))
    assert {r.key for r in keys.collect()} == {"p/a.txt", "p/b.md", "p/q/c.txt", "p/q/r/d.txt", "e.txt"}
    assert tuple(files.folder_size(spark, str(tmp_path)).first()) == (5, 500, "0.00")
    nodes = table(spark, [node("//p:all", inputs=["**/*.txt", "plain"], exclude_inputs=["q/c.txt"]), node("//p:top", inputs=["*.{txt,md}"]), node("//:root", inputs=["?.txt"]), node("//p/q:sub", inputs=["[cd].txt"])])
    got = {}
    for r in files.expand_inputs(nodes, keys.select("key")).collect():
        got.setdefault(r.label, set()).add(r.input)
    assert got == {"//p:all": {"a.txt", "q/r/d.txt", "plain"}, "//p:top": {"a.txt", "b.md"}, "//:root": {"e.txt"}, "//p/q:sub": {"c.txt"}}
    assert {r.file for r in definitions.diff_files(spark, ["a", "b", ""], ["?? c", " M b", "R  x -> y"]).collect()} == {"a", "b", "c", "y"}


def test_globs_are_matched_once_for_all_that_ask_the_same(spark, monkeypatch):
    keys = spark.createDataFrame([(f"p/f{k}.txt",) for k in range(20)], "key string")
    same = [node(f"//p:t{k}", inputs=["f*.txt", "./plain"], exclude_inputs=["f1?.txt"]) for k in range(30)]
    nodes = table(spark, [*same, node("//p:two", inputs=["f1.txt"]), node("//p:two", inputs=["f?.txt"], exclude_inputs=["f1.txt"])])
    want = {(f"//p:t{k}", x) for k in range(30) for x in (*(f"f{n}.txt" for n in range(10)), "plain")} | {("//p:two", f"f{n}.txt") for n in range(10) if n != 1}
    for shared in (files.SHARED, 4):
        monkeypatch.setattr(files, "SHARED", shared)
        matched = []
        monkeypatch.setattr(files, "stage", lambda df, label: matched.append((label, out := stage(df, label))) or out)
        got = [tuple(r) for r in files.expand_inputs(nodes, keys).collect()]
        assert len(got) == len(want) and set(got) == want
        assert {label: t.count() for label, t in matched} == {"asks": 31, "ask-kinds": 2}


def test_documented(spark):
    b = frame(spark, [build(str(k), NOW + k * DAY, is_ci=True, total_targets=10 * (k + 1), cache_hit_count=5) for k in range(3)], BUILDS)
    s = frame(spark, [span(str(k)) for k in range(3)] * 2, SPANS)
    assert [r.hit_rate for r in D.daily_hit_rate(b).collect()] == [5 * 100 / 30, 25.0, 50.0]
    assert D.ci_hit_rate(b, NOW + 3 * DAY).count() == 3 and D.unnested(T.nested(b, s)).first().runs == 6
    assert D.slowest_span(b, s).first().trace_id == "0" and D.typed(b).first().start_time.year == 2024
    assert D.dashboard(b).count() == 3 and D.failed_builds(b).count() == 3 and D.long_queues(s, 100).count() == 6


def test_stream(spark, tmp_path):
    root = str(tmp_path / "t")
    hours = [build(str(k), NOW + k * 3_600_000) for k in range(8)]
    store.write_traces(frame(spark, hours, BUILDS), frame(spark, [span("1")], SPANS), root)
    q = ingest.append_to(ingest.windowed_stats(ingest.builds_stream(spark, root)), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("from").collect()
    assert got and all((r.builds, r.failures) == (1, 2) for r in got) and len(got) < 8  # the last windows may still grow
    assert ingest.spans_stream(spark, root).isStreaming


def test_dates(spark):
    assert X.since_millis("2024-10-04") == 20_000 * DAY
    assert spark.range(1).select(X.date_of(F.lit(20_000 * DAY - 1))).first()[0] == "2024-10-03"


def test_rendered_definitions_and_logs(spark, tmp_path):
    (tmp_path / "nodes.json").write_text(json.dumps({"label": "//:a", "package": "", "name": "a", "node_type": "target", "inputs": ["x"]}) + "\n")
    (tmp_path / "a.log").write_text("one\ntwo\n")
    assert [(r.label, list(r.inputs)) for r in definitions.from_json(spark, str(tmp_path / "nodes.json")).collect()] == [("//:a", ["x"])]
    assert [r.value for r in files.log_lines(spark, str(tmp_path / "a.log")).collect()] == ["one", "two"]


def test_staged_tables_can_be_cleared(spark):
    from tracewright import storage

    storage.clear_staged(spark)
    assert storage.stage(spark.range(3), "t").count() == 3
    assert storage.clear_staged(spark) == 1 and storage.clear_staged(spark) == 0

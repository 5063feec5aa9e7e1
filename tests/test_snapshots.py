"""Versions of the trace store, and exports that are written span by span."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_traces import DAY, NOW, build, frame, span
from tracewright.operators import traces as T
from tracewright.schemas import BUILDS, SPANS
from tracewright.sources import snapshots
from tracewright.sources import traces as store


def tables(spark, rows, spans):
    return frame(spark, rows, BUILDS), frame(spark, spans, SPANS)


def held(spark, root, **options):
    builds, spans = store.read_builds(spark, root, **options), store.read_spans(spark, root, **options)
    return sorted((r.trace_id, r.command) for r in builds.collect()), sorted((r.trace_id, r.label) for r in spans.collect())


def test_writing_again_replaces(spark, tmp_path):
    root = str(tmp_path / "a b")  # paths come back encoded
    first = tables(spark, [build("t1"), build("t2"), build("t3", NOW - DAY)], [span("t1"), span("t2"), span("t2", "//p:b"), span("t3"), span("none")])
    assert store.write_traces(*first, root) == 1 and store.write_traces(*first, root) == 2
    once = ([("t1", "build"), ("t2", "build"), ("t3", "build")], [("t1", "//pkg:target"), ("t2", "//p:b"), ("t2", "//pkg:target"), ("t3", "//pkg:target")])
    assert held(spark, root) == once
    moved = tables(spark, [build("t2", NOW - 5 * DAY, command="test")], [span("t2", "//p:c")])
    store.write_traces(*moved, root)
    assert held(spark, root) == ([("t1", "build"), ("t2", "test"), ("t3", "build")], [("t1", "//pkg:target"), ("t2", "//p:c"), ("t3", "//pkg:target")])
    assert held(spark, root, version=2) == once  # earlier versions can still be read
    assert held(spark, root, since="2024-10-04")[0] == [("t1", "build")] and held(spark, root, until="2024-10-03")[0] == [("t2", "test"), ("t3", "build")]
    assert snapshots.Store(spark, root).expire() > 0 and snapshots.Store(spark, root).versions() == [3]
    assert held(spark, root)[0] == [("t1", "build"), ("t2", "test"), ("t3", "build")]


def test_replacing_part_of_a_file_writes_no_other_row(spark, tmp_path):
    root, days = str(tmp_path), 12
    rows = [build(f"t{k}", NOW - k % days * DAY) for k in range(60)]
    store.write_traces(*tables(spark, rows, [span(r["trace_id"]) for r in rows]), root)
    first = snapshots.Store(spark, root).files()[1]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("again", "again")
    for k in range(3):  # the second and third leave nothing of the one before
        store.write_traces(*tables(spark, [build(f"t{t}", NOW - t % days * DAY, command=f"again{k}") for t in range(30)], [span(f"t{t}", "//p:b") for t in range(30)]), root)
    jobs = len(tracker.getJobIdsForGroup("again"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 120  # none for each day
    files = snapshots.Store(spark, root).files()[1]
    assert set(first) <= set(files) and {f.since for f in files} == {1, 2, 4} and {f.since for f in files if f.table == snapshots.REMOVED} <= {2, 3, 4}
    want = sorted((f"t{t}", "again2" if t < 30 else "build") for t in range(60))
    assert held(spark, root) == (want, sorted((f"t{t}", "//p:b" if t < 30 else "//pkg:target") for t in range(60)))
    assert store.compact(spark, root) == 5 and store.compact(spark, root) == 5
    assert snapshots.Store(spark, root).expire() > 0 and not any(f.table == snapshots.REMOVED for f in snapshots.Store(spark, root).listed())
    assert held(spark, root)[0] == want and held(spark, root, since="2024-10-04")[0] == [w for w in want if int(w[0][1:]) % days == 0]
    store.write_traces(*tables(spark, [build("t1")], []), root)
    assert held(spark, root)[0] == sorted([w for w in want if w[0] != "t1"] + [("t1", "build")])


@pytest.mark.parametrize("step", ["write", "commit", "_rename"])
def test_writers_that_die(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    rows = [build("old", NOW - 2 * DAY), build("edge-old", NOW - 10), build("new", NOW + 10)]
    store.write_traces(*tables(spark, rows, [span(r["trace_id"]) for r in rows]), root)
    before = held(spark, root)

    def dies(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots.Store, step, dies)
        with pytest.raises(OSError):
            store.prune(spark, root, NOW)
        with pytest.raises(OSError):
            store.write_traces(*tables(spark, [build("new", command="again")], [span("new")]), root)
    assert held(spark, root) == before
    assert store.prune(spark, root, NOW) == 2 and store.prune(spark, root, NOW) == 0
    assert held(spark, root) == ([("new", "build")], [("new", "//pkg:target")])
    kept = snapshots.Store(spark, root)
    kept.expire(unnamed=True)
    assert {f.path for f in kept.listed()} == {f.path for f in kept.files()[1]}


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path)
    store.write_traces(*tables(spark, [build("t1")], []), root)
    it = snapshots.Store(spark, root)
    base, files = it.files()
    assert it.commit(base, files) == base + 1
    with pytest.raises(snapshots.Conflict):
        it.commit(base, [])
    assert it.files() == (base + 1, files)


def test_files_of_other_tools_are_taken_in(spark, tmp_path):
    root = str(tmp_path)
    for table, df in zip(("builds", "spans"), tables(spark, [build("a"), build("b")], [span("a"), span("b")])):
        df.write.parquet(f"{root}/{table}/2024-10-04/")
    assert len(held(spark, root)[0]) == 2 and snapshots.Store(spark, root).versions() == []
    store.write_traces(*tables(spark, [build("b", command="test")], []), root)
    assert held(spark, root) == ([("a", "build"), ("b", "test")], [("a", "//pkg:target")])


def test_lookups_skip_row_groups(spark, tmp_path):
    root = str(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # these few rows would make one file
    builds = spark.range(4_000).select(F.sha2(F.col("id").cast("string"), 256).alias("trace_id"), F.lit(NOW).alias("start_time_unix_millis"))
    store.write_traces(builds.select(*[(F.col(f.name) if f.name in builds.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in BUILDS]), frame(spark, [], SPANS), root)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = builds.first()[0]
    found = store.read_builds(spark, root).where(F.col("trace_id") == one)
    assert found.count() == 1
    found.collect()
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = leaf.metrics().get("numOutputRows").get().value()
    assert 1 <= read <= 2_000  # a row group of several: their bloom filters tell


def test_lines_in_pieces_are_the_nested_ones(spark, tmp_path):
    rows = [build("t1"), build("t2", requested_patterns='a "}\n{'), build("none", is_ci=None), build("t3")]
    spans = [span("t1", f"//p:{k % 3}", start_time_unix_millis=NOW + k // 2, status="FAILURE" if k % 4 else "SUCCESS") for k in range(9)] + [span("t2", "é}\n", tags=None), span("t3"), span("t3"), span("orphan")]
    b, s = tables(spark, rows, spans)
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        store.write_json_lines(b, s, f"{tmp_path}/lines{parts}")
        store.write_otlp(b, s, f"{tmp_path}/otlp{parts}")
        for name, whole in (("lines", T.as_json_lines(b, s)), ("otlp", T.as_otlp(b, s))):
            got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/{name}{parts}").collect()]
            want = [json.loads(r.value) for r in whole.collect()]
            assert sorted(got, key=json.dumps) == sorted(want, key=json.dumps) and len(got) == 4
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    store.write_json_lines(*tables(spark, [], []), f"{tmp_path}/empty")
    assert spark.read.text(f"{tmp_path}/empty").count() == 0
    twice = T.json_line_pieces(b.union(b), s)
    assert twice.count() == T.json_line_pieces(b, s).count()


def test_exports_are_compressed(spark, tmp_path):
    b = frame(spark, [build(f"t{k}") for k in range(50)], BUILDS)
    s = frame(spark, [span(f"t{k % 50}", f"//p:{k}") for k in range(500)], SPANS)
    for name, write, whole in (("lines", store.write_json_lines, T.as_json_lines(b, s)), ("otlp", store.write_otlp, T.as_otlp(b, s)), ("document", store.write_otlp_document, T.as_otlp_document(b, s))):
        write(b, s, f"{tmp_path}/{name}")
        files = [f for f in (tmp_path / name).iterdir() if f.name.startswith("part-")]
        plain = whole.agg(F.sum(F.octet_length("value"))).first()[0]
        assert files and all(f.name.endswith(".gz") for f in files) and sum(f.stat().st_size for f in files) * 4 < plain
        want = [r.value for r in whole.collect()]
        assert sorted(r.value for r in spark.read.text(f"{tmp_path}/{name}").collect()) == sorted(want)
    gathered = T.nested(b, s, ["status"]).schema["spans"].dataType.elementType.fieldNames()
    assert gathered == ["start_time_unix_millis", "label", "trace_id", "status"]


def test_a_long_trace_in_pieces(spark, tmp_path):
    b = frame(spark, [build("t"), build("u")], BUILDS)
    many = frame(spark, [span("t")], SPANS).withColumn("label", F.explode(F.expr("transform(sequence(0, 49999), k -> '//p:' || k)")))
    store.write_json_lines(b, many, f"{tmp_path}/lines")
    assert T.json_line_pieces(b, many).agg(F.max(F.length("value"))).first()[0] < 5_000  # no row holds a trace
    lines = {x["trace_id"]: x["spans"] for x in (json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect())}
    assert lines["u"] is None and len(lines["t"]) == len({x["label"] for x in lines["t"]}) == 50_000


def test_spans_of_other_traces_stay_where_they_are(spark, monkeypatch):
    rows = spark.range(20_000).select(F.concat(F.lit("t"), F.col("id") % 10_000).alias("trace_id"), "id")
    ids = spark.range(0, 10_000, 10).select(F.concat(F.lit("t"), "id").alias("trace_id"))
    wanted = {r.id for r in rows.join(ids, "trace_id").collect()}
    for bits, most in ((1 << 27, 2_010), (1 << 16, 2_600), (8, 20_000)):  # a filter that is full lets all through
        monkeypatch.setattr(store, "FILTER_BITS", bits)
        got = [r.id for r in store._likely(rows, ids).collect()]
        assert wanted <= set(got) and len(got) == len(set(got)) and len(got) <= most
    assert store._likely(rows, ids.limit(0)).count() == 0
    assert store._likely(rows, ids).columns == rows.columns


def test_a_pull_shuffles_what_it_copies(spark, tmp_path, monkeypatch):
    seen, write = [], store.write_traces
    monkeypatch.setattr(store, "write_traces", lambda b, s, root: seen.append((b.count(), s.count())) or write(b, s, root))
    builds, spans = [build(f"t{k}") for k in range(200)], [span(f"t{k}", f"//p:{n}") for k in range(200) for n in range(3)]
    remote, local = f"{tmp_path}/remote", f"{tmp_path}/local"
    write(*tables(spark, builds, spans), remote)
    write(*tables(spark, builds[:190], spans), local)
    assert store.pull(spark, remote, local) == 10 and seen == [(10, 30)] and store.pull(spark, remote, local) == 0
    assert store.read_spans(spark, local).count() == 600 and store.read_builds(spark, local).count() == 200

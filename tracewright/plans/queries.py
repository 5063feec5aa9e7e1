"""The engine's queries over a folder of star-schema tables, by name. Names start with the operator's number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars as X
from tracewright.functions.labels import Pattern, completions, is_test, name_of, package_of, shortened
from tracewright.operators import changes as C
from tracewright.operators import checks, folders, graph, incremental, selection
from tracewright.operators import traces as T
from tracewright.plans import documented as D
from tracewright.plans import star

WINDOW = 200
SINCE = X.since_millis("1995-06-01")
UNTIL = X.since_millis("1998-08-01")

_all: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _all[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_all)


# ---- traces


@query
def a1_stats_recent(spark: SparkSession, d: str) -> DataFrame:
    return T.stats(star.builds(spark, d))


@query
def a1_stats_empty(spark: SparkSession, d: str) -> DataFrame:
    return T.stats(star.builds(spark, d), command="no such command")


@query
def a1_stats_ci(spark: SparkSession, d: str) -> DataFrame:
    return T.stats(star.builds(spark, d), limit=WINDOW, ci=True, since=SINCE)


@query
def a2_bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return T.bottlenecks(star.spans(spark, d), T.recent(star.builds(spark, d), WINDOW))


@query
def a3_overall_miss_rate(spark: SparkSession, d: str) -> DataFrame:
    rate = T.overall_miss_rate(a2_bottlenecks(spark, d))
    return rate.select(F.floor(F.col("overall_miss_rate") * 1_000_000).cast("long").alias("miss_rate_millionths"))


def _category(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = T.bottleneck_category(a2_bottlenecks(spark, d), name)
        return rows.select("label", "n", *dict.fromkeys(("impact", T.CATEGORIES[name])))

    run.__name__ = f"l6_bottleneck_{name}"
    return query(run)


for _name in T.CATEGORIES:
    _category(_name)


@query
def l1_list_recent(spark: SparkSession, d: str) -> DataFrame:
    return T.list_builds(star.builds(spark, d), since=SINCE).select("trace_id", "start_time_unix_millis", "command", "total_targets", "failure_count", "cache_hit_count")


@query
def l1_list_view(spark: SparkSession, d: str) -> DataFrame:
    return T.list_view(T.list_builds(star.builds(spark, d), limit=50)).drop("duration")


@query
def f3_list_failures(spark: SparkSession, d: str) -> DataFrame:
    return T.list_builds(star.builds(spark, d), limit=0, failures=True, command="1-URGENT", ci=False).select("trace_id", "failure_count")


@query
def f5_find_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return T.with_prefix(star.builds(spark, d), "12").select("trace_id", "command")


@query
def f7_spans_of_traces(spark: SparkSession, d: str) -> DataFrame:
    return T.spans_of(star.spans(spark, d), ["1", "22", "333"]).select("trace_id", "label", "total_duration_millis")


@query
def f9_prune_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return star.builds(spark, d).where(F.col("start_time_unix_millis") < UNTIL - X.age_millis("900d")).agg(F.count("*").alias("pruned"))


@query
def j1_recent_spans(spark: SparkSession, d: str) -> DataFrame:
    return T.recent_spans(star.spans(spark, d), T.recent(star.builds(spark, d), WINDOW)).select("trace_id", "label", "status", "cache_result", "total_duration_millis")


@query
def l5_show_trace(spark: SparkSession, d: str) -> DataFrame:
    return T.show_trace(star.spans(spark, d), "7", "command")


@query
def k2_export_nested(spark: SparkSession, d: str) -> DataFrame:
    rows = T.nested(star.builds(spark, d), star.spans(spark, d), ["total_duration_millis"])
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["total_duration_millis"])
    return rows.select("trace_id", F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), total.alias("sum_total"), F.col("spans")[0]["label"].alias("first_label"))


@query
def k2_json_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = T.as_json_lines(star.builds(spark, d), star.spans(spark, d))
    path = lambda p: F.get_json_object("value", p)
    return lines.select(path("$.trace_id").alias("trace_id"), path("$.command").alias("command"), path("$.spans[0].label").alias("first_label"), path("$.total_targets").cast("int").alias("total_targets"))


@query
def k3_otlp_export(spark: SparkSession, d: str) -> DataFrame:
    docs = T.as_otlp(star.builds(spark, d), star.spans(spark, d))
    path = lambda p: F.get_json_object("value", p)
    docs = docs.select("trace_id", F.get_json_object("value", "$.scopeSpans[0].spans[0]").alias("value"), F.get_json_object("value", "$.scopeSpans[0].spans[1]").alias("child"))
    child = lambda p: F.get_json_object("child", p)
    return docs.select(
        "trace_id", path("$.traceId").alias("trace_hex"), path("$.name").alias("root_name"), path("$.startTimeUnixNano").alias("start_nano"), path("$.endTimeUnixNano").alias("end_nano"), path("$.status.code").cast("int").alias("status_code"),
        path("$.attributes[3].value.intValue").alias("total_targets"), path("$.attributes[6].value.boolValue").cast("boolean").alias("is_ci"), child("$.name").alias("first_child"), (child("$.parentSpanId") == path("$.spanId")).alias("linked"),
        child("$.attributes[0].value.stringValue").alias("cache_result"), child("$.attributes[1].value.stringValue").alias("change_hash"), child("$.attributes[3].value.intValue").alias("command_ms"),
    )


@query
def k3_otlp_document(spark: SparkSession, d: str) -> DataFrame:
    """The lines of one document over all traces, read back as JSON."""
    from tracewright.sources import traces as stored
    from tracewright.storage import new_folder

    path = new_folder(spark, "otlp")
    stored.write_otlp_document(star.builds(spark, d), star.spans(spark, d), path)
    lines = spark.read.text(path)
    body = lines.where(F.col("value").contains("scopeSpans")).select(F.from_json(F.ltrim("value", F.lit(",")), "struct<scopeSpans: array<struct<spans: array<struct<name: string, traceId: string>>>>>").alias("r"), (~F.col("value").startswith(",")).cast("int").alias("first"))
    spans = body.select("first", F.col("r.scopeSpans")[0]["spans"].alias("spans")).select("first", F.col("spans")[0]["traceId"].alias("trace_hex"), F.size("spans").cast("long").alias("n_spans"))
    return spans.unionByName(lines.where(~F.col("value").contains("scopeSpans")).select(F.lit(-1).alias("first"), F.col("value").alias("trace_hex"), F.lit(0).cast("long").alias("n_spans")))


@query
def x21_identifiers(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("trace_id")
    return star.builds(spark, d).select("trace_id", X.trace_hex(t).alias("trace_hex"), X.span_hex(t, F.lit("r")).alias("span_hex"), X.trace_hex(F.concat(F.lpad(t, 16, "0"), F.lpad(t, 16, "0"))).alias("as_uuid"))


@query
def j3_trace_header(spark: SparkSession, d: str) -> DataFrame:
    return T.trace_header(star.builds(spark, d), "7")


@query
def l4_slowest_targets(spark: SparkSession, d: str) -> DataFrame:
    return T.show_trace(star.spans(spark, d), "7", top=3).select("label", "total_duration_millis")


@query
def x9_rate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Rates of builds, whole numbers, megabytes and platforms as text."""
    b = star.builds(spark, d).where("total_targets > 0")
    rate = F.col("cache_hit_count") * F.lit(100.0) / F.col("total_targets")
    return b.select("trace_id", X.percent_text(rate).alias("rate"), X.whole_text(F.col("total_duration_millis")).alias("whole"), X.megabytes(F.col("total_targets") * 262_144).alias("megabytes"), X.platform_text(F.lit("linux"), F.lit("arm64")).alias("platform"))


@query
def k1_stored_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces of one month's days written by date and read back: builds and spans of each day, and a store that isn't there."""
    from tracewright.sources import traces as stored
    from tracewright.storage import new_folder

    root = new_folder(spark, "store")
    month = F.col("start_time_unix_millis") % (30 * 24 * X.HOUR)
    stored.write_traces(star.builds(spark, d).withColumn("start_time_unix_millis", month), star.spans(spark, d, by_trace=True), root)
    builds, spans = stored.read_builds(spark, root), stored.read_spans(spark, root)
    none = stored.read_builds(spark, f"{root}/none").agg(F.count("*")).scalar()
    each = builds.select("trace_id", X.date_of(F.col("start_time_unix_millis")).alias("day"), "failure_count").join(spans.groupBy("trace_id").agg(F.count("*").alias("n")), "trace_id", "left")
    return each.groupBy("day").agg(F.count("*").alias("builds"), F.sum("n").alias("spans"), F.sum("failure_count").alias("failures")).withColumn("elsewhere", none)


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    """Builds with their starts moved into one month, so that a store has 30 days."""
    return star.builds(spark, d).withColumn("start_time_unix_millis", F.col("start_time_unix_millis") % (30 * 24 * X.HOUR))


def _stored_traces(spark: SparkSession, root: str) -> DataFrame:
    from tracewright.sources import traces as stored

    n = stored.read_spans(spark, root).groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.sum("total_duration_millis").alias("millis"))
    return stored.read_builds(spark, root).select("trace_id", "command", "start_time_unix_millis").join(n, "trace_id", "left")


@query
def k12_replaced_traces(spark: SparkSession, d: str) -> DataFrame:
    """A store in which the failed builds are written again, twice, with their failed spans: all traces it holds."""
    from tracewright.sources import traces as stored
    from tracewright.storage import new_folder

    root = new_folder(spark, "replaced")
    builds, spans = _monthly(spark, d), star.spans(spark, d, by_trace=True)
    stored.write_traces(builds, spans, root)
    for _ in range(2):
        stored.write_traces(builds.where("failure_count > 0").withColumn("command", F.lit("again")), spans.where("status = 'FAILURE'"), root)
    return _stored_traces(spark, root)


@query
def k13_pruned_store(spark: SparkSession, d: str) -> DataFrame:
    """A store pruned within a day: all traces that stay, and how many went."""
    from tracewright.sources import traces as stored
    from tracewright.storage import new_folder

    root = new_folder(spark, "pruned-store")
    stored.write_traces(_monthly(spark, d).withColumn("start_time_unix_millis", F.col("start_time_unix_millis") + F.col("total_targets") * X.HOUR), star.spans(spark, d, by_trace=True), root)
    gone = stored.prune(spark, root, 15 * 24 * X.HOUR + 2 * X.HOUR)
    return _stored_traces(spark, root).withColumn("pruned", F.lit(gone).cast("long"))


@query
def j10_pulled_store(spark: SparkSession, d: str) -> DataFrame:
    """A store of failed builds that pulls from one of all, twice: what it holds, and how many each pull copied."""
    from tracewright.sources import traces as stored
    from tracewright.storage import new_folder

    remote, local = new_folder(spark, "remote"), new_folder(spark, "local")
    builds, spans = _monthly(spark, d), star.spans(spark, d, by_trace=True)
    stored.write_traces(builds, spans, remote)
    stored.write_traces(builds.where("failure_count > 0"), spans, local)
    first, again = stored.pull(spark, remote, local), stored.pull(spark, remote, local)
    return _stored_traces(spark, local).withColumns({"first": F.lit(first).cast("long"), "again": F.lit(again).cast("long")})


@query
def k3_written_otlp(spark: SparkSession, d: str) -> DataFrame:
    """OTLP lines written span by span and read back: every span of every trace."""
    from tracewright.sources import traces as stored
    from tracewright.storage import new_folder

    path = new_folder(spark, "otlp-lines")
    stored.write_otlp(star.builds(spark, d), star.spans(spark, d), path)
    span = "struct<traceId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: int>>"
    lines = spark.read.schema(f"scopeSpans array<struct<spans: array<{span}>>>").json(path)
    each = lines.select(F.inline(F.col("scopeSpans")[0]["spans"]))
    return each.select(F.col("traceId").alias("trace_hex"), F.col("parentSpanId").isNull().alias("root"), "name", F.col("startTimeUnixNano").alias("start_nano"), F.col("endTimeUnixNano").alias("end_nano"), F.col("status.code").alias("code"))


@query
def k2_written_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written span by span and read back: every span of every trace."""
    from tracewright.sources import traces as stored
    from tracewright.storage import new_folder

    path = new_folder(spark, "json-lines")
    stored.write_json_lines(star.builds(spark, d), star.spans(spark, d), path)
    _, spans = stored.read_json_lines(spark, path)
    return spans.select("trace_id", "label", "status", "cache_result", "change_hash", "start_time_unix_millis", "total_duration_millis", "queue_wait_millis")


@query
def e12_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Exported JSON lines, read back as two tables."""
    from tracewright.sources import traces as stored
    from tracewright.storage import new_folder

    path = new_folder(spark, "lines")
    stored.write_json_lines(star.builds(spark, d), star.spans(spark, d), path)
    builds, spans = stored.read_json_lines(spark, path)
    return builds.select("trace_id", "command", "is_ci").join(spans.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.sum("total_duration_millis").alias("millis")), "trace_id", "left")


@query
def s5_json_definitions(spark: SparkSession, d: str) -> DataFrame:
    """A definition file per package, written and loaded: labels, dependencies and outputs of its targets and aliases."""
    from tracewright.sources.definitions import load
    from tracewright.storage import new_folder

    p = F.col("p_partkey")
    target = F.struct(F.concat(F.lit("n"), p.cast("string")).alias("name"), F.col("p_name").alias("command"), F.array(F.concat(F.lit(":n"), F.expr("p_partkey div 2").cast("string")), F.lit("//top")).alias("dependencies"), F.array(F.concat(F.lit("dir::o"), p.cast("string"))).alias("outputs"))
    packed = star.table(spark, d, "part").groupBy(F.pmod(p, F.lit(20)).alias("folder")).agg(F.collect_list(target).alias("targets"))
    alias = F.array(F.struct(F.lit("any").alias("name"), F.concat(F.lit(":n"), F.col("folder").cast("string")).alias("actual")))
    root = new_folder(spark, "workspace")
    files = packed.select(F.to_json(F.struct("targets", alias.alias("aliases"))).alias("value"), F.concat(F.lit("p"), F.col("folder").cast("string")).alias("package"))
    for package in [f"p{k}" for k in range(20)]:  # a fixed number of folders
        files.where(F.col("package") == package).select("value").coalesce(1).write.text(f"{root}/{package}")
    loaded = load(spark, root, names={"part-*": "json"})
    return loaded.select("label", "node_type", F.array_join("dependencies", ",").alias("dependencies"), F.get("outputs", F.lit(0))["type"].alias("output_type"), "actual")


@query
def s13_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files listed, sized and read: the sums of what was written."""
    from tracewright.sources import files
    from tracewright.storage import new_folder

    root = new_folder(spark, "files")
    star.table(spark, d, "part").select("p_name").repartition(5).write.text(root)
    listed = files.listing(spark, root, ".txt").agg(F.count_if(F.col("length") > 0).alias("n"), F.sum("length").alias("listed"))
    read = files.contents(spark, root, "*.txt").agg(F.sum(F.octet_length("content")).alias("content_bytes"))
    size = files.folder_size(spark, root).select((F.col("files") > 0).alias("some"))
    lines = files.log_lines(spark, root).agg(F.count("*").alias("lines"))
    return spark.range(1).select(listed.select("listed").scalar().alias("listed"), read.scalar().alias("content_bytes"), size.scalar().alias("some"), lines.scalar().alias("lines"))


# ---- documented questions


@query
def e1_recent_builds(spark: SparkSession, d: str) -> DataFrame:
    return D.recent_builds(star.builds(spark, d))


@query
def e2_slowest_misses(spark: SparkSession, d: str) -> DataFrame:
    return D.slowest_misses(star.spans(spark, d))


@query
def e3_daily_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return D.daily_hit_rate(star.builds(spark, d))


@query
def e4_by_io(spark: SparkSession, d: str) -> DataFrame:
    return D.by_io(star.spans(spark, d))


@query
def e7_daily_durations(spark: SparkSession, d: str) -> DataFrame:
    return D.daily_durations(star.builds(spark, d))


@query
def e8_ci_avg_of_ratios(spark: SparkSession, d: str) -> DataFrame:
    return D.ci_hit_rate(star.builds(spark, d), UNTIL, days=400)


@query
def e9_per_day_and_command(spark: SparkSession, d: str) -> DataFrame:
    return D.per_day_and_command(star.builds(spark, d), UNTIL, days=400)


@query
def e10_unnested(spark: SparkSession, d: str) -> DataFrame:
    return D.unnested(T.nested(star.builds(spark, d), star.spans(spark, d), ["total_duration_millis", "cache_result"]))


@query
def e13_slowest_builds(spark: SparkSession, d: str) -> DataFrame:
    return D.slowest_builds(star.builds(spark, d))


@query
def e13_miss_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.miss_counts(star.spans(spark, d))


@query
def e13_long_queues(spark: SparkSession, d: str) -> DataFrame:
    return D.long_queues(star.spans(spark, d))


@query
def e13_command_averages(spark: SparkSession, d: str) -> DataFrame:
    return D.command_averages(star.spans(spark, d))


@query
def e14_slowest_span(spark: SparkSession, d: str) -> DataFrame:
    return D.slowest_span(star.builds(spark, d), star.spans(spark, d))


@query
def e15_failed_builds(spark: SparkSession, d: str) -> DataFrame:
    return D.failed_builds(star.builds(spark, d))


@query
def e16_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return D.dashboard(star.builds(spark, d))


# ---- graph


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph, its two tables staged: walks read them in every round."""
    from tracewright.storage import stage

    return stage(star.nodes(spark, d, spread=True), "nodes"), _edges(spark, d)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph's edges alone, staged."""
    from tracewright.storage import stage

    return stage(star.edges(spark, d, spread=True), "edges")


def _label(p: int) -> str:
    return f"//g{p % 7}/p{p % 50}:n{p}" + ("_test" if p % 40 == 0 else "")


@query
def g3_deps_direct(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct(star.edges(spark, d), _label(199), "deps")


@query
def g4_rdeps_direct(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct(star.edges(spark, d), _label(7), "rdeps")


def _one(spark: SparkSession, p: int) -> DataFrame:
    return spark.createDataFrame([(_label(p),)], "label string")


@query
def g5_deps_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_counts(_edges(spark, d), _one(spark, 199), "deps").select("label", F.col("paths").cast("long").alias("paths"))


@query
def g6_rdeps_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_counts(_edges(spark, d), _one(spark, 7), "rdeps").select("label", F.col("paths").cast("long").alias("paths"))


@query
def g7_rdeps_set(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(_edges(spark, d), _one(spark, 7), "rdeps")


@query
def g8_topo_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(*_parts(spark, d))


@query
def g9_longest_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    weight = F.when(F.col("node_type") == "target", F.col("execution_millis") + F.col("cache_millis")).otherwise(0)
    return graph.longest_paths(nodes.select("label", weight.alias("weight")), edges).select("label", "total")


@query
def g9_critical_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.critical_path(*_parts(spark, d)).select(F.concat_ws(" ", "path").alias("path"), "exec_millis", "cache_millis")


@query
def g11_induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = star.nodes(spark, d), star.edges(spark, d)
    return graph.induced(nodes.where(F.col("package").startswith("g1/") | F.col("package").startswith("g0/")), edges)


@query
def g12_build_selection(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    return selection.build_selection(nodes, edges, "linux/amd64", patterns=[Pattern.parse("//g3/...")])


@query
def a7_selection_counts(spark: SparkSession, d: str) -> DataFrame:
    return selection.selection_counts(star.nodes(spark, d), "linux/amd64", patterns=[Pattern.parse("//...")])


@query
def f11_pattern_recursive(spark: SparkSession, d: str) -> DataFrame:
    return selection.list_nodes(star.nodes(spark, d), patterns=[Pattern.parse("//g3/..."), Pattern.parse("//g1/p1:all")])


@query
def f12_select_tags(spark: SparkSession, d: str) -> DataFrame:
    return selection.list_nodes(star.nodes(spark, d), tags=["tag1", "tag2"], exclude_tags=["Brand#12"])


@query
def f14_platform(spark: SparkSession, d: str) -> DataFrame:
    return selection.list_nodes(star.nodes(spark, d), host="linux/amd64", tags=["tag3"])


@query
def f15_tests(spark: SparkSession, d: str) -> DataFrame:
    return selection.list_nodes(star.nodes(spark, d), kind="test")


@query
def f15_bin_outputs(spark: SparkSession, d: str) -> DataFrame:
    return selection.list_nodes(star.nodes(spark, d), kind="bin_output", patterns=[Pattern.parse("//...")])


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Some inputs and one definition, as a diff would list them."""
    nodes = star.nodes(spark, d)
    one = C.input_files(nodes).where(F.col("file").rlike("src1[0-9]?.txt$")).select("file")
    return C.changed_files(one, spark.createDataFrame([("g3/p3/BUILD.json",)], "file string"))


@query
def u1_changed_files(spark: SparkSession, d: str) -> DataFrame:
    return _changed(spark, d)


@query
def j7_owners(spark: SparkSession, d: str) -> DataFrame:
    return C.owners(star.nodes(spark, d), _changed(spark, d))


@query
def j8_touched(spark: SparkSession, d: str) -> DataFrame:
    return C.touched(star.nodes(spark, d), _changed(spark, d))


@query
def g14_changes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    return C.changes(nodes, edges, _changed(spark, d), dependents="transitive", exclude_tags=["tag4"])


@query
def g15_affected_index(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    return C.affected_index(nodes, edges, _changed(spark, d)).select("label", F.array_join("files", ",").alias("files"))


@query
def g16_consumer_roots(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    return C.consumer_roots(nodes, edges, _changed(spark, d))


def _clashing(spark: SparkSession, d: str) -> DataFrame:
    """The graph's nodes with outputs in shared folders: of each sixty parts some write a folder, a folder in it, files in
    it, and images."""
    number = F.regexp_extract("label", ":n([0-9]+)", 1).cast("long")
    place = lambda by, *after: F.concat(F.lit("../../shared/d"), F.floor(number / 60).cast("string"), F.lit("/f" if by else ""), *([F.floor(number / by).cast("string")] if by else []), *map(F.lit, after))
    one = lambda kind, name: F.struct(F.lit(kind).alias("type"), name.alias("identifier"))
    output = F.when(number % 12 == 0, one("dir", place(0, "/./sub/"))).when(number % 12 == 6, one("dir", place(0))).when(number % 6 == 1, one("file", place(30, ".txt"))).when(number % 6 == 2, one("oci", F.concat(F.lit("img"), F.floor(number / 60).cast("string"))))
    return star.nodes(spark, d, spread=True).withColumn("outputs", F.array(output.otherwise(one("file", F.concat(F.lit("own"), number.cast("string")))))).withColumn("bin_output", F.lit(None).cast("struct<type: string, identifier: string>"))


@query
def g19_output_conflicts(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.storage import stage

    nodes = _clashing(spark, d).select("label", "package", "node_type", "outputs", "bin_output")
    return checks.output_conflicts(stage(nodes, "nodes"), _edges(spark, d))


@query
def g20_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Every check has something to find: paths that are absolute or lead out, idle targets, pushes without an image,
    tests and test-only targets in the wrong hands."""
    nodes, edges = _parts(spark, d)
    p = F.regexp_extract("label", ":n([0-9]+)", 1).cast("long")
    text, none = p.cast("string"), F.array().cast("array<string>")
    image = F.struct(F.lit("oci").alias("type"), F.concat(F.lit("img"), text).alias("identifier"))
    lost = F.when(p % 31 == 0, F.concat(F.lit("/abs"), text)).when(p % 37 == 0, F.concat(F.lit("../../../up"), text))
    nodes = nodes.withColumns({
        "inputs": F.when(p % 41 == 0, none).when(p % 113 == 0, F.array(F.concat(F.lit("/etc/x"), text))).otherwise(F.col("inputs")),
        "dependencies": F.when(p % 41 == 0, none).otherwise(F.array(F.lit("//:any"))),
        "fingerprint": F.when(p % 41 == 0, F.create_map().cast("map<string, string>")).otherwise(F.col("fingerprint")),
        "output_checks": none,
        "outputs": F.concat("outputs", F.when(p % 86 == 0, F.array(image)).otherwise(F.array().cast("array<struct<type: string, identifier: string>>")), F.when(lost.isNotNull(), F.array(F.struct(F.lit("file").alias("type"), lost.alias("identifier")))).otherwise(F.array().cast("array<struct<type: string, identifier: string>>"))),
        "oci_push": F.when(p % 43 == 0, F.create_map(F.concat(F.lit("img"), text), F.array(F.lit("registry")))).otherwise(F.create_map().cast("map<string, array<string>>")),
        "tags": F.when(p % 17 == 0, F.array_append("tags", F.lit("testonly"))).otherwise(F.col("tags")),
    })
    return checks.constraints(nodes, edges)


@query
def a10_duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    nodes = star.nodes(spark, d).select("label", "node_type")
    return checks.duplicate_labels(nodes.unionByName(nodes.where("node_type = 'resource'")))


@query
def j4_missing_dependencies(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = star.nodes(spark, d), star.edges(spark, d)
    return checks.dangling(nodes.where("node_type = 'target'"), edges)


@query
def g2_self_loops(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = star.nodes(spark, d), star.edges(spark, d)
    own = nodes.where("node_type = 'resource'").select(F.col("label").alias("src"), F.col("label").alias("dst"))
    return graph.self_loops(edges.unionByName(own))


@query
def g1_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of nodes by their dependency lists; resources stand in as aliases of part 1."""
    nodes, edges = star.nodes(spark, d), star.edges(spark, d)
    lists = edges.groupBy(F.col("dst").alias("label")).agg(F.collect_list("src").alias("dependencies"))
    full = nodes.select("label", F.when(F.col("node_type") == "resource", _label(1)).alias("actual")).join(lists, "label", "left")
    return graph.edges_of(full)


@query
def g12_platform_error(spark: SparkSession, d: str) -> DataFrame:
    found = selection.platform_error(*_parts(spark, d), "linux/amd64", patterns=[Pattern.parse("//g3/...")])
    return found.select(F.size("chain").alias("steps"), F.element_at("chain", -1).alias("misfit"), F.col("message").contains("which does not match the platform linux/amd64").alias("said"))


@query
def g21_completions(spark: SparkSession, d: str) -> DataFrame:
    return completions(star.nodes(spark, d).select("package", "name"), "//g3/p1")


@query
def k4_graph_json(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_json(star.nodes(spark, d), star.edges(spark, d))


@query
def k5_mermaid(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.operators import render

    return render.mermaid(*_parts(spark, d))


@query
def k6_dependency_trees(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.operators import render

    return render.dependency_trees(*_parts(spark, d))


@query
def x11_label_parts(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label")
    return star.nodes(spark, d).select("label", package_of(label).alias("package"), name_of(label).alias("name"), is_test(label).alias("is_test"), shortened(label).alias("short"))


@query
def x18_hashes(spark: SparkSession, d: str) -> DataFrame:
    return star.nodes(spark, d).select("label", X.list_hash(F.col("inputs")).alias("inputs_hash"), X.map_text(F.col("fingerprint")).alias("fingerprint_text"))


# ---- incremental computation


@query
def i1_definition_hash(spark: SparkSession, d: str) -> DataFrame:
    nodes = star.nodes(spark, d)
    return nodes.select("label", incremental.definition_hash(F.array().cast("array<string>"), "linux/amd64").alias("definition_hash"))


@query
def i4_early_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """A second build after every fifth target's contents changed; half of those still make the same output."""
    nodes, edges = _parts(spark, d)
    number = F.regexp_extract("label", ":n([0-9]+)", 1).cast("long")
    first = nodes.select("label", F.sha2("label", 256).alias("content_hash"))
    made = nodes.where("node_type = 'target'").select("label", F.sha2(F.concat(F.lit("out"), "label"), 256).alias("output_hash"))
    none = spark.createDataFrame([], "change_hash string, output_hash string")
    before = incremental.plan_builds(nodes, edges, first, none, made)
    changed = first.withColumn("content_hash", F.when(F.pmod(number, F.lit(5)) == 0, F.sha2(F.concat("label", F.lit("2")), 256)).otherwise(F.col("content_hash")))
    again = made.withColumn("output_hash", F.when(F.pmod(number, F.lit(10)) == 0, F.sha2(F.concat(F.lit("new"), "label"), 256)).otherwise(F.col("output_hash")))
    return incremental.plan_builds(nodes, edges, changed, before.select("change_hash", "output_hash"), again).select("label", "level", "hit")


@query
def i4_delta(spark: SparkSession, d: str) -> DataFrame:
    """The second build of ``i4_early_cutoff``, planned from the first one and what changed: all targets visited, and
    whether their output changed."""
    nodes, edges = _parts(spark, d)
    number = F.regexp_extract("label", ":n([0-9]+)", 1).cast("long")
    first = nodes.select("label", F.sha2("label", 256).alias("content_hash"))
    made = nodes.where("node_type = 'target'").select("label", F.sha2(F.concat(F.lit("out"), "label"), 256).alias("output_hash"))
    before = incremental.plan_builds(nodes, edges, first, spark.createDataFrame([], "change_hash string, output_hash string"), made)
    changed = nodes.where(F.pmod(number, F.lit(5)) == 0).select("label")
    contents = first.withColumn("content_hash", F.when(F.pmod(number, F.lit(5)) == 0, F.sha2(F.concat("label", F.lit("2")), 256)).otherwise(F.col("content_hash")))
    again = made.withColumn("output_hash", F.when(F.pmod(number, F.lit(10)) == 0, F.sha2(F.concat(F.lit("new"), "label"), 256)).otherwise(F.col("output_hash")))
    delta = incremental.plan_delta(nodes, edges, before, changed, contents, before.select("change_hash", "output_hash"), again)
    return delta.select("label", "level", "hit", "output_hash", (F.col("output_hash") != F.col("was")).alias("moved"))


def _part_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files of a tree per brand: in folders named by the words of their types, some in upper folders; every
    50th is a link."""
    p = F.col("p_partkey")
    folder = F.when(p % 11 == 0, "").when(p % 7 == 0, F.split("p_type", " ")[0]).otherwise(F.replace("p_type", F.lit(" "), F.lit("/")))
    link = p % 50 == 0
    return star.table(spark, d, "part").select(
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("root"), F.concat_ws("/", F.when(folder != "", folder), F.concat(F.lit("n"), p.cast("string"), F.lit(".txt"))).alias("path"), F.when(link, "link").otherwise("file").alias("kind"),
        F.sha2("p_name", 256).alias("digest"), F.octet_length("p_name").cast("long").alias("size"), (p % 3 == 0).alias("executable"), F.when(link, F.lit("n1.txt")).alias("target"),
    )


@query
def i5_folder_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digest, files and bytes of every folder of all trees (S14, S16, I5)."""
    return folders.folder_digests(_part_files(spark, d))


@query
def i7_no_cache_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Output hashes of targets that are never cached: each makes a brand's whole tree and one of its files (I7)."""
    files = _part_files(spark, d).withColumn("path", F.concat_ws("/", "root", "path"))
    outputs = files.groupBy("root").agg(F.min(F.when(F.col("kind") == "file", F.col("path"))).alias("first"))
    out = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.col(name).alias("identifier"))
    nodes = outputs.select(
        F.concat(F.lit("//:"), "root").alias("label"), F.lit("").alias("package"), F.lit("target").alias("node_type"), F.array(F.lit("no-cache")).alias("tags"), F.array(out("dir", "root"), out("file", "first")).alias("outputs"),
        F.lit(None).cast("struct<type: string, identifier: string>").alias("bin_output"),
    )
    return folders.no_cache_hashes(nodes, files)


@query
def i2_change_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Change and output hashes: of targets with and without inputs and outputs (I2, I5, I6)."""
    nodes = star.nodes(spark, d)
    number = F.regexp_extract("label", ":n([0-9]+)", 1).cast("long")
    inputs = F.when(number % 3 != 0, F.col("inputs")).otherwise(F.array().cast("array<string>"))
    digests = F.when(number % 4 != 0, F.array(F.lit("z"), F.concat(F.lit("d"), number.cast("string"))))
    rows = nodes.select("label", incremental.change_hash(F.sha2("label", 256), F.sha2("name", 256), inputs).alias("change_hash"), digests.alias("digests"))
    return rows.select("label", "change_hash", incremental.output_hash(F.col("digests"), F.col("change_hash")).alias("output_hash"))


@query
def i9_taints(spark: SparkSession, d: str) -> DataFrame:
    nodes = star.nodes(spark, d)
    store = incremental.taint(nodes.where(F.col("node_type") == "resource").select("label"), nodes.where(F.array_contains("tags", "tag1")).select("label"))
    return incremental.untaint(store, nodes.where(F.array_contains("tags", "Brand#12")).select("label"))


@query
def a6_errors(spark: SparkSession, d: str) -> DataFrame:
    s = star.spans(spark, d)
    done = s.select(F.concat("trace_id", "label", F.lit("#"), F.col("cache_check_millis").cast("string")).alias("label"), (F.col("status") == "SUCCESS").alias("is_success"), F.when(F.col("status") == "FAILURE", F.concat(F.lit("failed: "), "command")).alias("err"), "cache_result")
    return incremental.errors(done)


@query
def i10_failure_propagation(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    return incremental.completed(nodes, edges, _one(spark, 9).union(_one(spark, 50)))


@query
def a4_completion_counts(spark: SparkSession, d: str) -> DataFrame:
    return incremental.completion_counts(star.spans(spark, d).select((F.col("status") == "SUCCESS").alias("is_success"), "cache_result"))


@query
def k11_new_content(spark: SparkSession, d: str) -> DataFrame:
    blobs = star.spans(spark, d).select(F.col("output_hash").alias("digest"))
    known = blobs.where(F.col("digest").startswith("1"))
    return incremental.new_content(blobs, known)


@query
def k12_latest_results(spark: SparkSession, d: str) -> DataFrame:
    rows = star.spans(spark, d).select("change_hash", F.col("trace_id").alias("output_hash"), (F.col("start_time_unix_millis") * 1000 + F.col("trace_id").cast("long")).alias("version"))
    return incremental.latest_results(rows, "version").select("change_hash", "version")


@query
def j10_pull_keys(spark: SparkSession, d: str) -> DataFrame:
    remote = star.spans(spark, d).select(F.col("trace_id").alias("key"))
    local = star.builds(spark, d).where("failure_count > 0").select(F.col("trace_id").alias("key"))
    return incremental.missing_keys(remote, local)


@query
def a9_outputs_by_tag(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    return incremental.outputs_by_tag(nodes, edges, _label(199)).select("tag", F.array_join("outputs", ",").alias("outputs"))


# ---- scalar functions, paths and definitions


@query
def x5_text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Durations in tenths of a second, so that no rounding is open."""
    s = star.spans(spark, d)
    tenths = (F.expr("total_duration_millis div 100") * 100).alias("t")
    rows = s.select("trace_id", "label", "start_time_unix_millis", tenths, "status", "cache_result", "command", F.col("queue_wait_millis").alias("q"))
    return rows.select(
        "trace_id", "label", "start_time_unix_millis", X.duration_text(F.col("t")).alias("total"), X.duration_text(F.col("q") % 1000).alias("queue"), X.status_text(F.col("status")).alias("status"),
        X.cache_text(F.col("cache_result")).alias("cache"), X.impact_band(F.col("t")).alias("band"), X.nanos(F.col("start_time_unix_millis")).alias("nanos"), X.date_of(F.col("start_time_unix_millis")).alias("day"),
    )


@query
def x13_command_texts(spark: SparkSession, d: str) -> DataFrame:
    long = F.concat(F.repeat(F.concat("command", F.lit(" é")), 12), F.lit("\nsecond line"))
    rows = star.spans(spark, d).select("command", long.alias("long")).distinct()
    return rows.select("command", X.ellipsis(F.col("long")).alias("shown"), F.octet_length(X.first_bytes(F.col("long"), 64)).alias("bytes"), X.sanitised(F.col("long")).alias("sanitised"))


@query
def x15_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths with dots in several places (F17, F18, X15)."""
    p = F.col("p_partkey")
    raw = F.concat(F.when(p % 3 == 0, "./").when(p % 3 == 1, "../").otherwise(""), F.lit("d"), (p % 10).cast("string"), F.when(p % 2 == 0, "/../e//f").otherwise("/g/./h"))
    rows = star.table(spark, d, "part").select(p.alias("part"), raw.alias("raw"))
    return rows.select("part", X.clean_path(F.col("raw")).alias("path"), X.escapes(F.col("raw")).alias("escapes"), X.inside(X.clean_path(F.col("raw")), F.lit("e")).alias("inside"))


@query
def x16_outputs(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "oci::").when(F.col("p_partkey") % 3 == 1, "dir::").otherwise(""), "p_name")
    rows = star.table(spark, d, "part").select(F.col("p_partkey").alias("part"), X.parsed_output(text).alias("o"))
    return rows.select("part", "o.type", "o.identifier", X.output_text(F.col("o")).alias("text"))


@query
def x20_resource_identity(spark: SparkSession, d: str) -> DataFrame:
    p = star.table(spark, d, "part")
    exports = F.create_map(F.lit("TYPE"), F.col("p_type"), F.lit("BRAND"), F.col("p_brand"))
    ident = X.resource_identity(star.part_label(F.col("p_partkey")), F.col("p_name"), F.lit("stop"), F.lit(""), F.lit("5m0s"), F.array(F.lit("//:db")), exports)
    return p.select(F.col("p_partkey").alias("part"), ident.alias("identity"))


@query
def j9_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Parts from 50 on stand for the part of half their number; chains end in a target or a resource."""
    p = F.col("p_partkey")
    kind = F.when(p % 97 == 0, "resource").when(p < 50, "target").otherwise("alias")
    nodes = star.table(spark, d, "part").select(p.cast("string").alias("label"), kind.alias("node_type"), F.expr("p_partkey div 2").cast("string").alias("actual"))
    return graph.resolve_aliases(nodes)


@query
def j21_tool_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = incremental.tool_paths(star.nodes(spark, d), star.edges(spark, d), _label(150))
    return rows.select("name", "binary", F.array_join("outputs", ",").alias("outputs"))


@query
def g10_cycle(spark: SparkSession, d: str) -> DataFrame:
    """The graph with one edge back, from part 64 to part 2: a row per label of the cycle."""
    edges = _parts(spark, d)[1].union(spark.createDataFrame([(_label(64), _label(2))], "src string, dst string"))
    return graph.find_cycle(edges)


@query
def s11_expand_inputs(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.sources.files import expand_inputs

    own = star.nodes(spark, d).where("node_type = 'target'")
    listed = C.input_files(own).select(F.col("file").alias("key")).distinct()
    asked = own.select("label", "package", F.array(F.lit("src1*.txt"), F.lit("plain")).alias("inputs"), F.array(F.lit("src1?.txt")).alias("exclude_inputs"))
    return expand_inputs(asked, listed)


@query
def i13_assembled_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each part completes once; phases follow from its number."""
    nodes = star.nodes(spark, d).withColumn("dependencies", F.array().cast("array<string>"))
    number = F.regexp_extract("label", ":n([0-9]+)", 1).cast("long")
    from tracewright.schemas import PHASES

    done = nodes.select("label", (number % 9 != 0).alias("is_success"), F.when(number % 2 == 0, "CACHE_HIT").otherwise("CACHE_MISS").alias("cache_result"), F.when(number % 18 == 0, "failed").alias("err"), number.alias("start_time_unix_millis"), *[(number % (k + 2)).alias(c) for k, c in enumerate(PHASES)])
    _, spans = T.assemble(done, nodes, spark.createDataFrame([("t",)], "trace_id string"))
    return spans.select("label", "status", "cache_result", "total_duration_millis", "end_time_unix_millis", "is_test", "tags")


@query
def i13_assembled_build(spark: SparkSession, d: str) -> DataFrame:
    s = i13_assembled_spans(spark, d)
    return s.agg(F.count("*").alias("total_targets"), F.count_if(F.col("status") == "SUCCESS").alias("success_count"), F.count_if(F.col("status") == "FAILURE").alias("failure_count"), F.count_if((F.col("status") == "SUCCESS") & (F.col("cache_result") == "CACHE_HIT")).alias("cache_hit_count"))


@query
def i3_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    nodes = star.nodes(spark, d)
    files = C.input_files(nodes).select("file", F.encode("file", "UTF-8").alias("content")).distinct()
    return incremental.content_hashes(nodes, files)


@query
def i8_hits(spark: SparkSession, d: str) -> DataFrame:
    s = star.spans(spark, d)
    rows = s.select("trace_id", "label", "start_time_unix_millis", F.when(F.col("cache_result") == "CACHE_HIT", F.col("change_hash")).alias("cached"), F.col("is_test").alias("tainted"), F.when(F.col("status") == "FAILURE", F.array(F.lit("no-cache"))).alias("tags"))
    return rows.select("trace_id", "label", "start_time_unix_millis", incremental.is_hit(F.col("cached"), F.col("tainted"), F.col("tags")).alias("hit"))


@query
def k8_ranked_categories(spark: SparkSession, d: str) -> DataFrame:
    return T.ranked_categories(a2_bottlenecks(spark, d)).select("category", "place", "label")

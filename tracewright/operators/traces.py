"""Questions over build traces: listing, statistics, bottlenecks, exports.

``builds`` has a row per invocation, ``spans`` a row per target of an invocation (see schemas). Equal start times are
ordered by trace_id, so every top-k has one answer. I/O is defined twice, as in the commands it serves: ``io_ms_stats``
leaves out the loading of dependencies, ``io_ms_show`` counts it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions import scalars as X
from tracewright.storage import stage

RECENT = 20
#: Thresholds of the bottleneck report (all strict), and entries of a category.
QUEUE_MS, IO_MS, HASH_MS, MISS_POINTS, PER_CATEGORY = 500, 1_000, 200, 30, 10


class TraceError(LookupError):
    """No trace, or more than one, where one was asked for."""


def newest(builds: DataFrame, limit: int = RECENT) -> DataFrame:
    """Newest first; below 0 the default, 0 all."""
    ordered = builds.orderBy(F.col("start_time_unix_millis").desc(), "trace_id")
    limit = RECENT if limit < 0 else limit
    return ordered.limit(limit) if limit else ordered


def filtered(builds: DataFrame, since: int | None = None, command: str | None = None, failures: bool = False, ci: bool | None = None) -> DataFrame:
    """All filters stand before a limit; Catalyst pushes them into the scan."""
    if since is not None:
        builds = builds.where(F.col("start_time_unix_millis") >= since)
    if command and command != "all":
        builds = builds.where(F.col("command") == command)
    if failures:
        builds = builds.where(F.col("failure_count") > 0)
    return builds if ci is None else builds.where(F.col("is_ci") == ci)


def recent(builds: DataFrame, limit: int = RECENT, **filters) -> DataFrame:
    """The window of statistics: the newest builds that fit; 0 and below mean the default."""
    return newest(filtered(builds, **filters), limit if limit > 0 else RECENT)


def list_builds(builds: DataFrame, limit: int = RECENT, **filters) -> DataFrame:
    return newest(filtered(builds, **filters), limit)


def list_view(builds: DataFrame) -> DataFrame:
    """What a listing shows."""
    rate = F.try_divide(F.col("cache_hit_count") * 100.0, F.col("total_targets"))
    return builds.select(
        X.short_id(F.col("trace_id")).alias("trace"), X.date_of(F.col("start_time_unix_millis")).alias("date"), "command", X.duration_text(F.col("total_duration_millis")).alias("duration"),
        "total_targets", "failure_count", F.coalesce(rate, F.lit(0.0)).alias("hit_rate"), X.hit_rate_band(F.coalesce(rate, F.lit(0.0))).alias("hit_band"), X.short_commit(F.col("git_commit")).alias("commit"), "is_ci",
    )


def with_prefix(builds: DataFrame, prefix: str) -> DataFrame:
    return builds.where(F.col("trace_id").startswith(prefix))


def find_trace(builds: DataFrame, prefix: str) -> str:
    """The one trace id that starts so."""
    found = [r[0] for r in with_prefix(builds, prefix).select("trace_id").distinct().orderBy("trace_id").take(2)]
    if not found:
        raise TraceError(f"no trace starts with {prefix!r}")
    if len(found) > 1:
        raise TraceError(f"{prefix!r} is ambiguous: {found[0]}, {found[1]}, ...")
    return found[0]


def spans_of(spans: DataFrame, trace_ids: Sequence[str]) -> DataFrame:
    """Spans of some traces; the ids are part of the filter, which reaches the scan."""
    return spans.where(F.col("trace_id").isin(list(trace_ids)))


def recent_spans(spans: DataFrame, window: DataFrame) -> DataFrame:
    """Spans of the traces in a recency window, whose size is its limit."""
    return spans.join(F.broadcast(window.select("trace_id")), "trace_id", "left_semi")


def io_ms_stats() -> Column:
    return F.col("output_write_millis") + F.col("output_load_millis") + F.col("cache_write_millis")


def io_ms_show() -> Column:
    return io_ms_stats() + F.col("dep_load_millis")


SHOW_KEYS = {"total": "total_duration_millis", "command": "command_duration_millis", "queue": "queue_wait_millis", "hash": "hash_duration_millis"}


def show_trace(spans: DataFrame, trace_id: str, sort_by: str = "total", top: int = 0) -> DataFrame:
    """The targets of one trace, slowest first by total, command, queue or hash; top 0 shows all."""
    rows = spans.where(F.col("trace_id") == trace_id).orderBy(F.col(SHOW_KEYS[sort_by]).desc(), "label", "start_time_unix_millis")
    rows = rows.limit(top) if top else rows
    return rows.select("label", X.status_text(F.col("status")).alias("status"), X.cache_text(F.col("cache_result")).alias("cache"), "total_duration_millis", "command_duration_millis", "queue_wait_millis", "hash_duration_millis", io_ms_show().alias("io_ms_show"))


def trace_header(builds: DataFrame, trace_id: str) -> DataFrame:
    """What stands above a trace's targets: one row of texts; none for an unknown id."""
    rate = F.coalesce(F.try_divide(F.col("cache_hit_count") * F.lit(100.0), F.col("total_targets")), F.lit(0.0))
    return builds.where(F.col("trace_id") == trace_id).select(
        "trace_id", "command", X.date_of(F.col("start_time_unix_millis")).alias("date"), X.duration_text(F.col("total_duration_millis")).alias("duration"), X.short_commit(F.col("git_commit")).alias("commit"), "git_branch", "platform",
        "total_targets", "success_count", "failure_count", X.percent_text(rate).alias("hit_rate"),
    )


def stats(builds: DataFrame, limit: int = RECENT, **filters) -> DataFrame:
    """One row over the window: build_count, avg_duration, cache_hit_rate (ratio of sums, percent), failure_count. On
    an empty window 0, null, null, 0."""
    rate = F.sum("cache_hit_count").cast("double") / F.nullif(F.sum("total_targets"), F.lit(0).cast("long")) * 100
    return recent(builds, limit, **filters).agg(
        F.count("*").alias("build_count"), F.avg("total_duration_millis").alias("avg_duration"), rate.alias("cache_hit_rate"), F.coalesce(F.sum("failure_count"), F.lit(0).cast("long")).alias("failure_count")
    )


def bottlenecks(spans: DataFrame, window: DataFrame) -> DataFrame:
    """Measures of every label with more than one span in the window."""
    s = recent_spans(spans, window)
    n = F.count("*")
    grouped = s.groupBy("label").agg(
        n.alias("n"),
        F.avg("total_duration_millis").alias("avg_total"),
        F.avg("command_duration_millis").alias("avg_command"),
        F.max("total_duration_millis").alias("max_total"),
        F.avg("queue_wait_millis").alias("avg_queue"),
        F.avg("hash_duration_millis").alias("avg_hash"),
        F.avg(io_ms_stats()).alias("avg_io"),
        F.avg("dep_load_millis").alias("avg_dep_load"),
        F.count_if(F.col("cache_result") == "CACHE_MISS").alias("misses"),
        F.count_if(F.col("status") == "FAILURE").alias("failures"),
    ).where("n > 1")
    per = grouped.withColumn("builds", window.agg(F.count("*")).scalar())
    return per.select(
        "label", "n", (F.col("n").cast("double") / F.col("builds")).alias("frequency"), (F.col("avg_command") * F.col("n") / F.col("builds")).alias("impact"), "avg_total", "avg_command", "max_total", "avg_queue",
        "avg_hash", "avg_io", "avg_dep_load", (F.col("misses") * 100.0 / F.col("n")).alias("miss_rate"), "failures",
    )


CATEGORIES = {"impact": "impact", "queue": "avg_queue", "io": "avg_io", "hash": "avg_hash", "miss": "miss_rate", "flaky": "failures"}


def bottleneck_category(measures: DataFrame, category: str, per: int = PER_CATEGORY) -> DataFrame:
    """The first ``per`` labels by impact that pass the category's threshold, then by the category's own measure."""
    metric = CATEGORIES[category]
    limits = {"queue": F.col("avg_queue") > QUEUE_MS, "io": F.col("avg_io") > IO_MS, "hash": F.col("avg_hash") > HASH_MS, "flaky": F.col("failures") > 0, "impact": F.lit(True)}
    if category == "miss":
        # Mean of the labels' rates, not of all spans.
        passing = measures.where(F.col("miss_rate") > measures.agg(F.avg("miss_rate")).scalar() + MISS_POINTS)
    else:
        passing = measures.where(limits[category])
    return passing.orderBy(F.col("impact").desc(), "label").limit(per).orderBy(F.col(metric).desc(), "label")


def overall_miss_rate(measures: DataFrame) -> DataFrame:
    return measures.agg(F.avg("miss_rate").alias("overall_miss_rate"))


def ranked_categories(measures: DataFrame, per: int = PER_CATEGORY) -> DataFrame:
    """All categories in one table: (category, place, label, value)."""
    out, measures = None, stage(measures, "measures")
    for name, metric in CATEGORIES.items():
        part = bottleneck_category(measures, name, per).select("label", F.col(metric).cast("double").alias("value"))
        part = part.withColumn("place", F.row_number().over(Window.orderBy(F.col("value").desc(), "label"))).select(F.lit(name).alias("category"), "place", "label", "value")
        out = part if out is None else out.unionByName(part)
    return out


# ---- exports


def nested(builds: DataFrame, spans: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Builds with their spans as an array in a stable order; null without spans. ``columns`` names those of a span that
    are needed beside start and label: others aren't gathered."""
    if columns is not None:
        spans = spans.select(*dict.fromkeys(("trace_id", "start_time_unix_millis", "label", *columns)))
    one = F.struct("start_time_unix_millis", "label", *[c for c in spans.columns if c not in ("start_time_unix_millis", "label")])
    spans = spans.repartition("trace_id")  # rows go as they are: gathering them before saves nothing, and its sort spills
    lists = spans.groupBy(F.col("trace_id").alias("_trace")).agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return builds.join(lists, F.col("trace_id") == F.col("_trace"), "left").drop("_trace")


def as_json_lines(builds: DataFrame, spans: DataFrame) -> DataFrame:
    """One JSON text per build (value), fit for the text sink. Builds without spans say null."""
    full = nested(builds, spans)
    return full.select(F.to_json(F.struct(*full.columns), {"ignoreNullFields": "false"}).alias("value"))


#: Columns that an OTLP export needs, of a build and of a span beside its start and label.
_OTLP_BUILD = ("trace_id", "workspace", "git_commit", "git_branch", "tool_version", "platform", "command", "start_time_unix_millis", "total_duration_millis", "total_targets", "failure_count", "cache_hit_count", "is_ci", "requested_patterns")
_OTLP_SPAN = (
    "change_hash", "status", "cache_result", "is_test", "end_time_unix_millis", "queue_wait_millis", "hash_duration_millis", "command_duration_millis", "output_write_millis", "output_load_millis", "cache_write_millis",
)


def _otlp(b: Callable[[str], Column], prefix: str, service: str) -> tuple[Column, Callable[[Column, Column], Column]]:
    """(text up to the root span, text of a child from a span and its place) of a build whose columns ``b`` gives. Both are
    JSON but for a last brace. They are put together from texts, since ``to_json`` of such a structure takes several times
    as long."""
    given = lambda *xs: F.coalesce(F.concat(*xs), F.lit(""))  # noqa: E731  nothing if any is null, as to_json does
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    literal = lambda x: F.lit(json.dumps(x, ensure_ascii=False))

    def attribute(key: str, kind: str, x: Column) -> Column:
        return F.concat(F.lit('{"key":'), literal(key if "." in key else f"{prefix}.{key}"), F.lit(',"value":{'), given(F.lit(f'"{kind}":'), x), F.lit("}}"))

    text, number, flag = (lambda k, x: attribute(k, "stringValue", X.json_text(F.coalesce(x, F.lit(""))))), (lambda k, x: attribute(k, "intValue", quoted(x.cast("string")))), (lambda k, x: attribute(k, "boolValue", x.cast("string")))
    listed = lambda xs: F.concat(F.lit('"attributes":['), *[y for k, x in enumerate(xs) for y in ([F.lit(","), x] if k else [x])], F.lit("]"))
    trace, root = X.trace_hex(b("trace_id")), X.span_hex(b("trace_id"), F.lit("root"))

    def span(ident: Column, parent: list[Column], name: Column, start: Column, end: Column, attributes: list[Column], bad: Column, *message: Column) -> Column:
        comma = F.lit(",")
        return F.concat(
            F.lit("{"), given(F.lit('"traceId":'), quoted(trace), comma), given(F.lit('"spanId":'), quoted(ident), comma), *parent, given(F.lit('"name":'), X.json_text(name), comma), F.lit('"kind":1,'),
            given(F.lit('"startTimeUnixNano":'), quoted(X.nanos(start)), comma), given(F.lit('"endTimeUnixNano":'), quoted(X.nanos(end)), comma), listed(attributes),
            F.lit(',"status":{"code":'), F.when(bad, "2").otherwise("1"), *message, F.lit("}"),
        )

    failed = b("failure_count") > 0
    top = span(
        root, [], F.concat(F.lit(f"{prefix} "), b("command")), b("start_time_unix_millis"), b("start_time_unix_millis") + b("total_duration_millis"),
        [*[text(c, b(c)) for c in ("workspace", "git_commit", "git_branch")], *[number(c, b(c)) for c in ("total_targets", "cache_hit_count", "failure_count")], flag("is_ci", b("is_ci")), text("requested_patterns", b("requested_patterns"))],
        failed, F.when(failed, F.concat(F.lit(',"message":"'), b("failure_count").cast("string"), F.lit(' targets failed"'))).otherwise(""),
    )

    def child(s: Column, i: Column) -> Column:
        return span(
            X.span_hex(b("trace_id"), F.concat(F.lit("span-"), i.cast("string"))), [given(F.lit('"parentSpanId":'), quoted(root), F.lit(","))], s["label"], s["start_time_unix_millis"], s["end_time_unix_millis"],
            [text("cache_result", s["cache_result"]), text("change_hash", s["change_hash"]), flag("is_test", s["is_test"]), *[number(k, s[c]) for k, c in (("command_duration_ms", "command_duration_millis"), ("queue_wait_ms", "queue_wait_millis"), ("hash_duration_ms", "hash_duration_millis"), ("output_write_ms", "output_write_millis"), ("output_load_ms", "output_load_millis"), ("cache_write_ms", "cache_write_millis"))]],
            s["status"] == "FAILURE",
        )

    resource = listed([text("service.name", F.lit(service)), text("service.version", b("tool_version")), text("host.arch", b("platform"))])
    scope = F.concat(F.lit('{"name":'), literal(service), given(F.lit(',"version":'), X.json_text(b("tool_version"))), F.lit("}"))
    return F.concat(F.lit('{"resource":{'), resource, F.lit('},"scopeSpans":[{"scope":'), scope, F.lit(',"spans":['), top), child


def in_export_order(builds: DataFrame, spans: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of an export in its order: per trace the build (kind 0), its spans (1) and an end (2).

    b and s hold the rows, ``place`` counts spans from 0, ``before`` is the kind of the row before and ``b_before`` its
    build. Spans are ordered as in ``nested``, but never gathered: a task reads its sorted traces row by row, however long one
    is. Spans without a build are left out; of builds that share a trace_id one is taken. ``columns`` names those of a
    span that are needed beside start and label: others aren't shuffled.
    """
    one = F.struct("start_time_unix_millis", "label", *[c for c in (spans.columns if columns is None else columns) if c not in ("start_time_unix_millis", "label")])
    rows = builds.select("trace_id", F.lit(0).alias("kind"), F.struct(*builds.columns).alias("b"))
    rows = rows.unionByName(spans.select("trace_id", F.lit(1).alias("kind"), one.alias("s")), allowMissingColumns=True)
    rows = rows.unionByName(builds.select("trace_id", F.lit(2).alias("kind")), allowMissingColumns=True)
    trace = Window.partitionBy("trace_id").orderBy("kind", "s")
    so_far = trace.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "before": F.lag("kind").over(trace), "b_before": F.lag("b").over(trace), "place": F.count_if(F.col("kind") == 1).over(so_far) - 1, "owner": F.min("kind").over(so_far),
    })
    return rows.where("owner = 0 AND NOT (kind <> 1 AND before <=> kind)").drop("owner")


#: What a text sink sets after each piece of an export: every object ends with it, so pieces leave it out.
PIECE_END = "}"


def _pieces(rows: DataFrame, starts: Column, value: Column) -> DataFrame:
    """Pieces of lines in the order of ``rows``; the first piece of a line breaks the line before, if its task has one."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its task
    rows = rows.select(starts.alias("starts"), value.alias("value")).withColumn("first", first)
    return rows.select(F.concat(F.when(F.col("starts") & ~F.col("first"), "\n").otherwise(""), "value").alias("value"))


def _open(text: Column, ends: int = 1) -> Column:
    """A JSON text without its last characters."""
    return F.substring(text, F.lit(1), F.char_length(text) - ends)


def json_line_pieces(builds: DataFrame, spans: DataFrame) -> DataFrame:
    """The lines of ``as_json_lines`` as pieces (value) of one span each, for a text sink with the line separator
    PIECE_END. A trace of any size is written row by row."""
    rows = in_export_order(builds, spans).where("kind > 0")
    head = F.concat(_open(F.to_json("b_before", {"ignoreNullFields": "false"})), F.lit(',"spans":'))
    starts = F.col("before") == 0
    body = _open(F.to_json("s", {"ignoreNullFields": "false"}))
    span = F.when(starts, F.concat(head, F.lit("["), body)).otherwise(F.concat(F.lit(","), body))
    end = F.when(starts, F.concat(head, F.lit("null"))).otherwise("]")
    return _pieces(rows, starts, F.when(F.col("kind") == 1, span).otherwise(end))


def otlp_pieces(builds: DataFrame, spans: DataFrame, prefix: str = "build", service: str = "tracewright") -> DataFrame:
    """The lines of ``as_otlp`` as pieces (value) of one span each, as ``json_line_pieces``."""
    rows = in_export_order(builds.select(*_OTLP_BUILD), spans, _OTLP_SPAN)
    head, child = _otlp(lambda c: F.col("trace_id" if c == "trace_id" else f"b.{c}"), prefix, service)
    kind = F.col("kind")
    return _pieces(rows, kind == 0, F.when(kind == 0, head).when(kind == 1, F.concat(F.lit(","), child(F.col("s"), F.col("place")))).otherwise("]}]"))


def as_otlp(builds: DataFrame, spans: DataFrame, prefix: str = "build", service: str = "tracewright") -> DataFrame:
    """(trace_id, value): one OTLP resource-spans object per trace, a root span and a child for each target.

    ``prefix`` starts the attribute keys and the root's name. A single document is {"resourceSpans": [values]}; one
    object per line keeps the export distributed. A row holds a whole trace; ``otlp_pieces`` doesn't.
    """
    full = nested(builds.select(*_OTLP_BUILD), spans, _OTLP_SPAN)
    return full.select("trace_id", _otlp_line(prefix, service).alias("value"))


def _otlp_line(prefix: str = "build", service: str = "tracewright") -> Column:
    """The text of a trace, from its build's columns and its ``spans``."""
    head, child = _otlp(F.col, prefix, service)
    children = F.transform("spans", lambda s, i: F.concat(F.lit(","), child(s, i), F.lit("}")))
    return F.concat(head, F.lit("}"), F.coalesce(F.array_join(children, ""), F.lit("")), F.lit("]}]}"))


def as_otlp_document(builds: DataFrame, spans: DataFrame, **options) -> DataFrame:
    """(place, value): the lines of one OTLP document over all traces, in order by place. Builds and spans are shuffled once,
    into the order of the document."""
    builds = builds.select(*_OTLP_BUILD)
    first = F.col("trace_id") == builds.agg(F.min("trace_id")).scalar()
    ends = builds.sparkSession.createDataFrame([(0, '{"resourceSpans":['), (2, "]}")], "place int, end string")
    one = F.struct("start_time_unix_millis", "label", *_OTLP_SPAN)
    rows = builds.select(F.lit(1).alias("place"), "trace_id", F.struct(*builds.columns).alias("b")).unionByName(spans.select(F.lit(1).alias("place"), "trace_id", one.alias("s")), allowMissingColumns=True)
    rows = rows.unionByName(ends, allowMissingColumns=True).repartitionByRange("place", "trace_id")
    lists = rows.groupBy("place", "trace_id").agg(F.collect_list("b").alias("builds"), F.array_sort(F.collect_list("s")).alias("spans"), F.first("end", ignorenulls=True).alias("end"))
    lists = lists.where((F.col("place") != 1) | (F.size("builds") > 0)).sortWithinPartitions("place", "trace_id")
    full = lists.select("place", "end", F.explode_outer("builds").alias("b"), F.when(F.col("trace_id").isNotNull(), F.col("spans")).alias("spans")).select("place", "end", "b.*", "spans")
    # Texts are made of sorted rows: they are several times as long.
    return full.select("place", F.when(F.col("place") == 1, F.concat(F.when(first, "").otherwise(","), _otlp_line(**options))).otherwise(F.col("end")).alias("value"))


# ---- assembly


def assemble(completions: DataFrame, nodes: DataFrame, build: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completions of one invocation -> its builds row and its spans.

    ``completions``: label, is_success, cache_result and the phase durations; ``build``: one row with the invocation's
    own columns. Only targets give spans. A failed target is recorded as a cache miss.
    """
    targets = nodes.where("node_type = 'target'").select("label", "package", "command", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"), X.joined(F.col("dependencies")).alias("dependencies"))
    from tracewright.schemas import PHASES

    total = sum((F.coalesce(F.col(c), F.lit(0).cast("long")) for c in PHASES[1:]), F.coalesce(F.col(PHASES[0]), F.lit(0).cast("long")))
    done = completions.join(targets, "label").withColumn("trace_id", build.select("trace_id").scalar())
    spans = done.withColumns({
        "status": F.when(F.col("is_success"), "SUCCESS").when(F.col("err").isNotNull(), "FAILURE").otherwise("CANCELLED"),
        "cache_result": F.when(F.col("is_success"), F.coalesce("cache_result", F.lit("CACHE_MISS"))).otherwise("CACHE_MISS"),
        "command": X.first_bytes(F.col("command")),
        "total_duration_millis": total,
        "is_test": F.col("label").endswith("test"),
    }).withColumn("end_time_unix_millis", F.col("start_time_unix_millis") + F.col("total_duration_millis")).drop("is_success", "err")
    ok = F.col("status") == "SUCCESS"
    counts = {"total_targets": F.count("*"), "success_count": F.count_if(ok), "failure_count": F.count_if(F.col("status") == "FAILURE"), "cache_hit_count": F.count_if(ok & (F.col("cache_result") == "CACHE_HIT"))}
    return build.withColumns({name: spans.agg(x.cast("int")).scalar() for name, x in counts.items()}), spans

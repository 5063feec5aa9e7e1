"""Schemas of traces, graphs and cached results. Times are epoch milliseconds, durations milliseconds."""

from __future__ import annotations

from pyspark.sql import types as T

#: One row per invocation. ``tool_version`` is the recording tool's version.
_BUILDS = (
    "trace_id string, workspace string, git_commit string, git_branch string, tool_version string, platform string, command string, "
    "start_time_unix_millis long, total_duration_millis long, total_targets int, success_count int, failure_count int, cache_hit_count int, "
    "critical_path_exec_millis long, critical_path_cache_millis long, async_cache_wait_millis long, is_ci boolean, requested_patterns string"
)
#: One row per completed target of an invocation.
_SPANS = (
    "trace_id string, label string, package string, change_hash string, output_hash string, status string, cache_result string, command string, "
    "exit_code int, is_test boolean, start_time_unix_millis long, end_time_unix_millis long, total_duration_millis long, queue_wait_millis long, "
    "hash_duration_millis long, cache_check_millis long, command_duration_millis long, output_write_millis long, output_load_millis long, "
    "cache_write_millis long, dep_load_millis long, tags string, dependencies string"
)
#: The phases that add up to a span's total duration.
PHASES = ("queue_wait_millis", "hash_duration_millis", "cache_check_millis", "command_duration_millis", "output_write_millis", "output_load_millis", "cache_write_millis", "dep_load_millis")
_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _flat(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


BUILDS, SPANS = _flat(_BUILDS), _flat(_SPANS)
#: A build with its spans, as in JSON lines.
NESTED = T.StructType([*BUILDS.fields, T.StructField("spans", T.ArrayType(SPANS))])

_OUTPUT = T.StructType([T.StructField("type", T.StringType()), T.StructField("identifier", T.StringType())])
_STRINGS = T.ArrayType(T.StringType())
_MAP = T.MapType(T.StringType(), T.StringType())
#: Targets, aliases and resources of a workspace. A null ``platforms`` takes the package's default.
NODES = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("label", "package", "name", "node_type", "command")],
        *[T.StructField(c, _STRINGS) for c in ("inputs", "exclude_inputs", "dependencies")],
        T.StructField("outputs", T.ArrayType(_OUTPUT)),
        T.StructField("bin_output", _OUTPUT),
        T.StructField("tags", _STRINGS),
        T.StructField("platforms", _STRINGS),
        T.StructField("fingerprint", _MAP),
        T.StructField("environment_variables", _MAP),
        T.StructField("oci_push", T.MapType(T.StringType(), _STRINGS)),
        T.StructField("output_checks", T.ArrayType(T.StructType([T.StructField("command", T.StringType()), T.StructField("expected_output", T.StringType())]))),
        T.StructField("timeout", T.StringType()),
        T.StructField("concurrency_group", T.StringType()),
        T.StructField("source_file_path", T.StringType()),
        T.StructField("actual", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("up", "down", "ready")],
        T.StructField("exports", _MAP),
    ]
)
#: src is the dependency, dst the dependant.
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])

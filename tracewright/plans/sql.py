"""DuckDB SQL for the engine's queries, over the same tables."""

from __future__ import annotations

_SINCE, _UNTIL, _DAY = 801_964_800_000, 901_929_600_000, 86_400_000

_SPANS = """
spans AS (
  SELECT *, start_time_unix_millis + total_duration_millis AS end_time_unix_millis FROM (
    SELECT *, queue_wait_millis + hash_duration_millis + cache_check_millis + command_duration_millis + output_write_millis + output_load_millis + cache_write_millis + dep_load_millis AS total_duration_millis FROM (
      SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, '//s' || (l_suppkey % 10) || ':t' || l_suppkey AS label, CAST(l_partkey AS VARCHAR) AS change_hash, l_partkey || '-out' AS output_hash,
        CASE l_returnflag WHEN 'R' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, CASE l_linestatus WHEN 'O' THEN 'CACHE_MISS' ELSE 'CACHE_HIT' END AS cache_result,
        epoch_ms(l_shipdate) + l_linenumber * 1000 AS start_time_unix_millis, CAST(floor(l_quantity * 20) AS BIGINT) AS queue_wait_millis, CAST(floor(l_tax * 6000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS hash_duration_millis,
        CAST(l_linenumber AS BIGINT) AS cache_check_millis, CAST(floor(l_extendedprice) AS BIGINT) AS command_duration_millis, CAST(floor(l_quantity * 30) AS BIGINT) AS output_write_millis,
        CAST(floor(l_discount * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS output_load_millis, CAST(l_linenumber * 100 AS BIGINT) AS cache_write_millis, CAST(l_partkey % 50 AS BIGINT) AS dep_load_millis
      FROM lineitem)))"""
_BUILDS = """
builds AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, sha256(CAST(o_custkey AS VARCHAR)) AS git_commit, o_orderpriority AS command, epoch_ms(o_orderdate) AS start_time_unix_millis,
    CAST(floor(o_totalprice) AS BIGINT) AS total_duration_millis, CAST(coalesce(t, 0) AS INT) AS total_targets, CAST(coalesce(r, 0) AS INT) AS failure_count, CAST(coalesce(h, 0) AS INT) AS cache_hit_count,
    CAST(floor(o_totalprice / 2) AS BIGINT) AS critical_path_exec_millis, o_orderstatus = 'F' AS is_ci
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS t, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'F') AS h FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def _recent(n: int, where: str = "true") -> str:
    return f"recent AS (SELECT * FROM builds WHERE {where} ORDER BY start_time_unix_millis DESC, trace_id LIMIT {n})"


_STATS = """SELECT count(*) AS build_count, avg(total_duration_millis) AS avg_duration, CAST(sum(cache_hit_count) AS DOUBLE) / nullif(sum(total_targets), 0) * 100 AS cache_hit_rate,
  CAST(coalesce(sum(failure_count), 0) AS BIGINT) AS failure_count FROM recent"""
_MEASURES = """measures AS (
  SELECT label, n, CAST(n AS DOUBLE) / b AS frequency, avg_command * n / b AS impact, avg_total, avg_command, max_total, avg_queue, avg_hash, avg_io, avg_dep_load, misses * CAST(100 AS DOUBLE) / n AS miss_rate, failures
  FROM (SELECT label, count(*) AS n, avg(total_duration_millis) AS avg_total, avg(command_duration_millis) AS avg_command, max(total_duration_millis) AS max_total, avg(queue_wait_millis) AS avg_queue,
      avg(hash_duration_millis) AS avg_hash, avg(output_write_millis + output_load_millis + cache_write_millis) AS avg_io, avg(dep_load_millis) AS avg_dep_load,
      count(*) FILTER (cache_result = 'CACHE_MISS') AS misses, count(*) FILTER (status = 'FAILURE') AS failures
    FROM spans WHERE trace_id IN (SELECT trace_id FROM recent) GROUP BY label HAVING count(*) > 1), (SELECT count(*) AS b FROM recent))"""
_BOTTLENECKS = f"WITH {_SPANS}, {_BUILDS}, {_recent(200)}, {_MEASURES} "
_CATEGORY = {
    "impact": ("impact", "true"), "queue": ("avg_queue", "avg_queue > 500"), "io": ("avg_io", "avg_io > 1000"), "hash": ("avg_hash", "avg_hash > 200"),
    "miss": ("miss_rate", "miss_rate > (SELECT avg(miss_rate) FROM measures) + 30"), "flaky": ("failures", "failures > 0"),
}


def _traces(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([_SPANS, _BUILDS, *ctes])} {body}"


_LABEL = lambda p: f"'//g' || ({p} % 7) || '/p' || ({p} % 50) || ':n' || {p} || CASE WHEN {p} % 40 = 0 THEN '_test' ELSE '' END"
_EDGE = "e AS (SELECT p_partkey // 2 AS s, p_partkey AS t FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey >= 3)"
_PACKAGE = "'g' || (p % 7) || '/p' || (p % 50)"
_PART = f"""n AS (
  SELECT *, {_LABEL('p')} AS label, {_PACKAGE} AS package, 'n' || p || CASE WHEN p % 40 = 0 THEN '_test' ELSE '' END AS name, p % 97 = 0 AS resource,
    [{_PACKAGE} || '/src' || p || '.txt', CASE WHEN p % 111 = 0 THEN 'g' || (p % 7) || '/up' ELSE {_PACKAGE} || '/lib' END || (p // 4) || '.txt'] AS files
  FROM (SELECT *, p_partkey AS p FROM part))"""
_FILES = "files AS (SELECT DISTINCT f AS file FROM (SELECT unnest(files) AS f FROM n WHERE NOT resource) WHERE regexp_matches(f, 'src1[0-9]?.txt$') UNION SELECT 'g3/p3/BUILD.json')"
_TOUCHED = f"touched AS (SELECT DISTINCT file, p FROM (SELECT p, unnest(files) AS file FROM n WHERE NOT resource UNION ALL SELECT p, {_PACKAGE} || '/BUILD.json' FROM n WHERE NOT resource) WHERE file IN (SELECT file FROM files))"
_AFFECTED = "affected AS (SELECT p FROM touched UNION SELECT t FROM affected JOIN e ON s = p)"


def _fold(rows: str) -> str:
    """Folders out of entries (root, folder, name, entry, files, bytes): texts dealt by the digest of their name."""
    return f"""SELECT root, folder, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
      FROM (SELECT root, folder, left(sha256(name), 2) AS part, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS digest, sum(files) AS files, sum(bytes) AS bytes FROM ({rows}) GROUP BY ALL) GROUP BY root, folder"""


def _level(depth: int) -> str:
    own = f"SELECT root, folder, name, entry, files, bytes FROM entries WHERE depth = {depth}"
    last, above = "regexp_extract(folder, '[^/]*$')", "regexp_replace(folder, '/?[^/]*$', '')"
    below = f" UNION ALL SELECT root, {above}, {last}, 'dir ' || digest || ' ' || {last}, files, bytes FROM d{depth + 1}" if depth < 3 else ""
    return f"d{depth} AS ({_fold(own + below)})"


_FOLDERS = f"""WITH entries AS (
  SELECT replace(p_brand, '#', '') AS root, folder, name, CASE WHEN link THEN 'link ' || sha256('n1.txt') ELSE 'file ' || sha256(p_name) || ' ' || octet_length(encode(p_name)) || CASE WHEN p % 3 = 0 THEN ' x' ELSE ' -' END END || ' ' || name AS entry,
    CASE WHEN link THEN 0 ELSE 1 END AS files, CASE WHEN link THEN 0 ELSE octet_length(encode(p_name)) END AS bytes, CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS depth, p_name, link
  FROM (SELECT *, p_partkey AS p, p_partkey % 50 = 0 AS link, 'n' || p_partkey || '.txt' AS name,
      CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN split_part(p_type, ' ', 1) ELSE replace(p_type, ' ', '/') END AS folder FROM part)),
{', '.join(_level(k) for k in (3, 2, 1, 0))}"""


def _graph(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join([_EDGE, _PART, *ctes])} {body}"


def _paths(start: int, here: str, there: str) -> str:
    walk = f"walk AS (SELECT {there} AS p FROM e WHERE {here} = {start} UNION ALL SELECT {there} FROM walk JOIN e ON {here} = p)"
    return _graph(f"SELECT {_LABEL('p')} AS label, count(*) AS paths FROM walk GROUP BY p", walk)


_TRACE_HEX = "rpad(lower(hex(encode(trace_id))), 32, '0')"
_OUT = "'out/' || (p // 2) || '.bin'"
_DOWN = "down AS (SELECT p AS head, p AS here, w AS total, 0 AS depth FROM weighed UNION ALL SELECT head, s, total + w, depth + 1 FROM down JOIN e ON t = here JOIN weighed ON p = s)"
_WEIGHED = "weighed AS (SELECT p, CASE WHEN resource THEN 0 ELSE p_size + p % 3 END AS w FROM n)"
_DAYTEXT = "strftime(make_timestamp(start_time_unix_millis * 1000), '%Y-%m-%d')"


def oracle_sql() -> dict[str, str]:
    out = {
        "a1_stats_recent": f"WITH {_BUILDS}, {_recent(20)} {_STATS}",
        "a1_stats_empty": f"WITH {_BUILDS}, {_recent(20, 'false')} {_STATS}",
        "a1_stats_ci": f"WITH {_BUILDS}, {_recent(200, f'is_ci AND start_time_unix_millis >= {_SINCE}')} {_STATS}",
        "a2_bottlenecks": _BOTTLENECKS + "SELECT * FROM measures",
        "a3_overall_miss_rate": _BOTTLENECKS + "SELECT CAST(floor(avg(miss_rate) * 1000000) AS BIGINT) AS miss_rate_millionths FROM measures",
        "l1_list_recent": _traces("SELECT trace_id, start_time_unix_millis, command, total_targets, failure_count, cache_hit_count FROM recent", _recent(20, f"start_time_unix_millis >= {_SINCE}")),
        "l1_list_view": _traces(
            f"""SELECT left(trace_id, 8) AS trace, {_DAYTEXT} AS date, command, total_targets, failure_count, r AS hit_rate, CASE WHEN r >= 70 THEN 'good' WHEN r >= 40 THEN 'warn' ELSE 'bad' END AS hit_band,
              left(git_commit, 7) AS commit, is_ci FROM (SELECT *, coalesce(cache_hit_count * CAST(100 AS DOUBLE) / nullif(total_targets, 0), 0) AS r FROM recent)""", _recent(50)),
        "f3_list_failures": _traces("SELECT trace_id, failure_count FROM builds WHERE failure_count > 0 AND command = '1-URGENT' AND NOT is_ci"),
        "f5_find_by_prefix": _traces("SELECT trace_id, command FROM builds WHERE starts_with(trace_id, '12')"),
        "f7_spans_of_traces": _traces("SELECT trace_id, label, total_duration_millis FROM spans WHERE trace_id IN ('1', '22', '333')"),
        "f9_prune_cutoff": _traces(f"SELECT count(*) AS pruned FROM builds WHERE start_time_unix_millis < {_UNTIL - 900 * _DAY}"),
        "j1_recent_spans": _traces("SELECT trace_id, label, status, cache_result, total_duration_millis FROM spans SEMI JOIN recent USING (trace_id)", _recent(200)),
        "l5_show_trace": _traces("""SELECT label, CASE status WHEN 'SUCCESS' THEN 'ok' ELSE 'FAIL' END AS status, CASE cache_result WHEN 'CACHE_HIT' THEN 'hit' ELSE 'miss' END AS cache, total_duration_millis, command_duration_millis,
            queue_wait_millis, hash_duration_millis, output_write_millis + output_load_millis + cache_write_millis + dep_load_millis AS io_ms_show FROM spans WHERE trace_id = '7'"""),
        "k2_export_nested": _traces("""SELECT trace_id, count(s.label) AS n_spans, CAST(sum(s.total_duration_millis) AS BIGINT) AS sum_total, arg_min(s.label, (s.start_time_unix_millis, s.label)) AS first_label
            FROM builds LEFT JOIN spans s USING (trace_id) GROUP BY trace_id"""),
        "k2_json_lines": _traces("""SELECT trace_id, any_value(command) AS command, arg_min(s.label, (s.start_time_unix_millis, s.label)) AS first_label, any_value(total_targets) AS total_targets
            FROM builds LEFT JOIN spans s USING (trace_id) GROUP BY trace_id"""),
        "k3_otlp_export": _traces(f"""SELECT trace_id, any_value({_TRACE_HEX}) AS trace_hex, 'build ' || any_value(b.command) AS root_name, any_value(b.start_time_unix_millis) || '000000' AS start_nano,
            any_value(b.start_time_unix_millis + b.total_duration_millis) || '000000' AS end_nano, any_value(CASE WHEN failure_count > 0 THEN 2 ELSE 1 END) AS status_code, CAST(any_value(total_targets) AS VARCHAR) AS total_targets, any_value(is_ci) AS is_ci,
            arg_min(s.label, (s.start_time_unix_millis, s.label)) AS first_child, CASE WHEN count(s.label) > 0 THEN true END AS linked, arg_min(s.cache_result, (s.start_time_unix_millis, s.label)) AS cache_result,
            arg_min(s.change_hash, (s.start_time_unix_millis, s.label)) AS change_hash, CAST(arg_min(s.command_duration_millis, (s.start_time_unix_millis, s.label)) AS VARCHAR) AS command_ms
            FROM builds b LEFT JOIN spans s USING (trace_id) GROUP BY trace_id"""),
        "k3_otlp_document": _traces(f"""SELECT CASE WHEN trace_id = (SELECT min(trace_id) FROM builds) THEN 1 ELSE 0 END AS first, {_TRACE_HEX} AS trace_hex, (SELECT count(*) FROM spans s WHERE s.trace_id = builds.trace_id) + 1 AS n_spans FROM builds
            UNION ALL SELECT -1, '{{"resourceSpans":[', 0 UNION ALL SELECT -1, ']}}', 0"""),
        "x21_identifiers": _traces(f"SELECT trace_id, {_TRACE_HEX} AS trace_hex, rpad(lower(hex(encode(trace_id || 'r'))), 16, '0') AS span_hex, lpad(trace_id, 16, '0') || lpad(trace_id, 16, '0') AS as_uuid FROM builds"),
        "j3_trace_header": _traces(f"""SELECT trace_id, command, {_DAYTEXT} AS date, printf('%.1fs', total_duration_millis / CAST(1000 AS DOUBLE)) AS duration, left(git_commit, 7) AS commit, 'main' AS git_branch, 'linux/amd64' AS platform, total_targets,
            total_targets - failure_count AS success_count, failure_count, printf('%.1f%%', cache_hit_count * CAST(100 AS DOUBLE) / total_targets) AS hit_rate FROM builds WHERE trace_id = '7'"""),
        "l4_slowest_targets": _traces("SELECT label, total_duration_millis FROM spans WHERE trace_id = '7' ORDER BY total_duration_millis DESC, label LIMIT 3"),
        "x9_rate_texts": _traces("""SELECT trace_id, printf('%.1f%%', cache_hit_count * CAST(100 AS DOUBLE) / total_targets) AS rate, CAST(total_duration_millis AS VARCHAR) AS whole, printf('%.2f', total_targets / CAST(4 AS DOUBLE)) AS megabytes, 'linux/arm64' AS platform
            FROM builds WHERE total_targets > 0"""),
        "k1_stored_traces": _traces(f"""SELECT strftime(make_timestamp(start_time_unix_millis % {30 * _DAY} * 1000), '%Y-%m-%d') AS day, count(*) AS builds, CAST(sum(n) AS BIGINT) AS spans, CAST(sum(failure_count) AS BIGINT) AS failures, 0 AS elsewhere
            FROM builds LEFT JOIN (SELECT trace_id, count(*) AS n FROM spans GROUP BY trace_id) USING (trace_id) GROUP BY day"""),
        "k12_replaced_traces": _traces(f"""SELECT b.trace_id, any_value(CASE WHEN failure_count > 0 THEN 'again' ELSE b.command END) AS command, any_value(b.start_time_unix_millis % {30 * _DAY}) AS start_time_unix_millis,
            nullif(count(s.label), 0) AS n_spans, CAST(sum(s.total_duration_millis) AS BIGINT) AS millis
            FROM builds b LEFT JOIN spans s ON s.trace_id = b.trace_id AND (failure_count = 0 OR status = 'FAILURE') GROUP BY b.trace_id"""),
        "k13_pruned_store": _traces(f"""SELECT *, (SELECT count(*) FROM builds) - count(*) OVER () AS pruned FROM (SELECT b.trace_id, any_value(b.command) AS command, any_value(b.start_time_unix_millis % {30 * _DAY} + total_targets * {_DAY // 24}) AS start_time_unix_millis,
            nullif(count(s.label), 0) AS n_spans, CAST(sum(s.total_duration_millis) AS BIGINT) AS millis
            FROM builds b LEFT JOIN spans s ON s.trace_id = b.trace_id WHERE b.start_time_unix_millis % {30 * _DAY} + total_targets * {_DAY // 24} >= {15 * _DAY + _DAY // 12} GROUP BY b.trace_id)"""),
        "j10_pulled_store": _traces(f"""SELECT b.trace_id, any_value(b.command) AS command, any_value(b.start_time_unix_millis % {30 * _DAY}) AS start_time_unix_millis, nullif(count(s.label), 0) AS n_spans, CAST(sum(s.total_duration_millis) AS BIGINT) AS millis,
            (SELECT count(*) FROM builds WHERE failure_count = 0) AS first, 0::BIGINT AS again FROM builds b LEFT JOIN spans s ON s.trace_id = b.trace_id GROUP BY b.trace_id"""),
        "k3_written_otlp": _traces(f"""SELECT {_TRACE_HEX} AS trace_hex, true AS root, 'build ' || command AS name, start_time_unix_millis || '000000' AS start_nano, (start_time_unix_millis + total_duration_millis) || '000000' AS end_nano, CASE WHEN failure_count > 0 THEN 2 ELSE 1 END AS code FROM builds
            UNION ALL SELECT {_TRACE_HEX}, false, label, start_time_unix_millis || '000000', end_time_unix_millis || '000000', CASE WHEN status = 'FAILURE' THEN 2 ELSE 1 END FROM spans WHERE trace_id IN (SELECT trace_id FROM builds)"""),
        "k2_written_lines": _traces("SELECT trace_id, label, status, cache_result, change_hash, start_time_unix_millis, total_duration_millis, queue_wait_millis FROM spans WHERE trace_id IN (SELECT trace_id FROM builds)"),
        "e12_json_lines": _traces("""SELECT trace_id, command, is_ci, n_spans, millis FROM builds LEFT JOIN (SELECT trace_id, count(*) AS n_spans, CAST(sum(total_duration_millis) AS BIGINT) AS millis FROM spans GROUP BY trace_id) USING (trace_id)"""),
        "s5_json_definitions": """SELECT '//p' || (p % 20) || ':n' || p AS label, 'target' AS node_type, '//p' || (p % 20) || ':n' || (p // 2) || ',//top:top' AS dependencies, 'dir' AS output_type, NULL::VARCHAR AS actual FROM (SELECT p_partkey AS p FROM part)
            UNION ALL SELECT '//p' || k || ':any', 'alias', '', NULL, '//p' || k || ':n' || k FROM (SELECT DISTINCT p_partkey % 20 AS k FROM part)""",
        "s13_listing": "SELECT CAST(sum(octet_length(encode(p_name)) + 1) AS BIGINT) AS listed, CAST(sum(octet_length(encode(p_name)) + 1) AS BIGINT) AS content_bytes, true AS some, count(*) AS lines FROM part",
        "i2_change_hashes": _graph(
            """SELECT label, change_hash, CASE WHEN p % 4 <> 0 THEN sha256('d' || p || ',z') ELSE change_hash END AS output_hash
              FROM (SELECT *, CASE WHEN p % 3 <> 0 THEN sha256(label) || '_' || sha256(name) ELSE sha256(label) END AS change_hash FROM n)"""),
        "i9_taints": _graph("SELECT label FROM n WHERE (resource OR p % 5 = 1) AND p_brand <> 'Brand#12'"),
        "a6_errors": _traces("SELECT trace_id || label || '#' || cache_check_millis AS label, 'failed: make ' || change_hash AS err FROM spans WHERE status = 'FAILURE'"),
        "e1_recent_builds": _traces("SELECT left(trace_id, 8) AS trace, command, total_duration_millis / CAST(1000 AS DOUBLE) AS seconds, total_targets, cache_hit_count, left(git_commit, 7) AS commit FROM recent", _recent(10)),
        "e2_slowest_misses": _traces("""SELECT label, count(*) AS runs, avg(total_duration_millis) AS avg_millis, avg(command_duration_millis) AS avg_command_millis FROM spans WHERE cache_result = 'CACHE_MISS'
            GROUP BY label HAVING count(*) > 3 ORDER BY avg_millis DESC, label LIMIT 10"""),
        "e3_daily_hit_rate": _traces(f"SELECT {_DAYTEXT} AS day, count(*) AS builds, sum(cache_hit_count) * CAST(100 AS DOUBLE) / nullif(sum(total_targets), 0) AS hit_rate FROM builds GROUP BY day ORDER BY day DESC LIMIT 14"),
        "e4_by_io": _traces("SELECT label, avg(output_write_millis) AS avg_write, avg(output_load_millis) AS avg_load, avg(output_write_millis + output_load_millis + cache_write_millis) AS avg_io FROM spans GROUP BY label ORDER BY avg_io DESC, label LIMIT 10"),
        "e7_daily_durations": _traces(f"SELECT {_DAYTEXT} AS day, avg(total_duration_millis) AS avg_millis, max(total_duration_millis) AS max_millis, count(*) AS builds FROM builds GROUP BY day"),
        "e8_ci_avg_of_ratios": _traces(f"""SELECT {_DAYTEXT} AS day, avg(CAST(floor(CAST(cache_hit_count AS BIGINT) * 100000000 / CAST(total_targets AS DOUBLE)) AS BIGINT)) / 1000000 AS avg_hit_rate, count(*) AS builds
            FROM builds WHERE is_ci AND total_targets > 0 AND start_time_unix_millis >= {_UNTIL - 400 * _DAY} GROUP BY day"""),
        "e9_per_day_and_command": _traces(f"""SELECT {_DAYTEXT} AS day, command, count(*) AS builds, avg(total_duration_millis) AS avg_millis, sum(cache_hit_count) * CAST(100 AS DOUBLE) / nullif(sum(total_targets), 0) AS hit_rate
            FROM builds WHERE start_time_unix_millis >= {_UNTIL - 400 * _DAY} GROUP BY day, command"""),
        "e10_unnested": _traces("SELECT label, count(*) AS runs, avg(total_duration_millis) AS avg_millis, count(*) FILTER (cache_result = 'CACHE_MISS') AS misses FROM spans GROUP BY label HAVING count(*) > 5"),
        "e13_slowest_builds": _traces("SELECT trace_id, total_duration_millis FROM builds ORDER BY total_duration_millis DESC, trace_id LIMIT 5"),
        "e13_miss_counts": _traces("SELECT label, count(*) AS misses FROM spans WHERE cache_result = 'CACHE_MISS' GROUP BY label"),
        "e13_long_queues": _traces("SELECT trace_id, label, queue_wait_millis, start_time_unix_millis FROM spans WHERE queue_wait_millis > 900"),
        "e13_command_averages": _traces("SELECT label, avg(command_duration_millis) AS avg_command_millis, count(*) AS runs FROM spans WHERE command_duration_millis > 0 GROUP BY label"),
        "e14_slowest_span": _traces("SELECT trace_id, label, total_duration_millis FROM spans ORDER BY total_duration_millis DESC, trace_id, label LIMIT 1"),
        "e15_failed_builds": _traces("SELECT trace_id, command, failure_count, total_duration_millis FROM builds WHERE failure_count > 0"),
        "e16_dashboard": _traces("SELECT start_time_unix_millis, trace_id, total_duration_millis, critical_path_exec_millis, cache_hit_count, total_targets, failure_count FROM builds"),
        "g3_deps_direct": _graph(f"SELECT {_LABEL('s')} AS label FROM e WHERE t = 199"),
        "g4_rdeps_direct": _graph(f"SELECT {_LABEL('t')} AS label FROM e WHERE s = 7"),
        "g5_deps_paths": _paths(199, "t", "s"),
        "g6_rdeps_paths": _paths(7, "s", "t"),
        "g7_rdeps_set": _graph(f"SELECT {_LABEL('p')} AS label FROM walk", "walk AS (SELECT t AS p FROM e WHERE s = 7 UNION SELECT t FROM walk JOIN e ON s = p)"),
        "g8_topo_levels": _graph(f"SELECT {_LABEL('head')} AS label, CAST(max(depth) AS INT) AS level FROM down GROUP BY head", _WEIGHED, _DOWN),
        "g9_longest_paths": _graph(f"SELECT {_LABEL('head')} AS label, CAST(max(total) AS BIGINT) AS total FROM down GROUP BY head", _WEIGHED, _DOWN),
        "g9_critical_path": _graph(
            "SELECT string_agg(label, ' ' ORDER BY k DESC) AS path, CAST(sum(CASE WHEN resource THEN 0 ELSE p_size END) AS BIGINT) AS exec_millis, CAST(sum(CASE WHEN resource THEN 0 ELSE p % 3 END) AS BIGINT) AS cache_millis FROM way JOIN n USING (p)",
            _WEIGHED, _DOWN, "best AS (SELECT head AS p, max(total) AS total, any_value(n.label) AS label FROM down JOIN n ON n.p = head GROUP BY head)",
            "before AS (SELECT t AS p, arg_min(s, (-best.total, best.label)) AS s FROM e JOIN best ON best.p = s GROUP BY t)",
            "way AS (SELECT arg_min(p, (-total, label)) AS p, 0 AS k FROM best UNION ALL SELECT before.s, k + 1 FROM way JOIN before ON before.p = way.p)"),
        "g11_induced_subgraph": _graph(f"SELECT {_LABEL('s')} AS src, {_LABEL('t')} AS dst FROM e WHERE s % 7 IN (0, 1) AND t % 7 IN (0, 1)"),
        "g12_build_selection": _graph(
            """SELECT label, p IN (SELECT p FROM chosen) AS chosen, p IN (SELECT p FROM need) AS ancestor, p IN (SELECT p FROM need) AND NOT fits AS platform_error
              FROM fit WHERE p IN (SELECT p FROM chosen) OR p IN (SELECT p FROM need)""",
            "fit AS (SELECT *, resource OR p % 13 <> 0 AS fits FROM n)", "chosen AS (SELECT p FROM fit WHERE p % 7 = 3 AND fits)", "need AS (SELECT s AS p FROM e WHERE t IN (SELECT p FROM chosen) UNION SELECT s FROM need JOIN e ON t = p)"),
        "a7_selection_counts": _graph("SELECT count(*) FILTER (resource OR p % 13 <> 0) AS selected, count(*) FILTER (NOT resource AND p % 13 = 0) AS platform_skipped FROM n"),
        "f11_pattern_recursive": _graph("SELECT label FROM n WHERE p % 7 = 3 OR (p % 7 = 1 AND p % 50 = 1)"),
        "f12_select_tags": _graph("SELECT label FROM n WHERE resource OR (p % 5 IN (1, 2) AND p_brand <> 'Brand#12')"),
        "f14_platform": _graph("SELECT label FROM n WHERE resource OR (p % 5 = 3 AND p % 13 <> 0)"),
        "f15_tests": _graph("SELECT label FROM n WHERE resource OR p % 40 = 0"),
        "f15_bin_outputs": _graph("SELECT label FROM n WHERE resource OR p % 25 = 0"),
        "u1_changed_files": _graph("SELECT file FROM files", _FILES),
        "j7_owners": _graph("SELECT DISTINCT label FROM (SELECT label, unnest(files) AS f FROM n WHERE NOT resource) WHERE f IN (SELECT file FROM files)", _FILES),
        "j8_touched": _graph("SELECT file, label FROM touched JOIN n USING (p)", _FILES, _TOUCHED),
        "g14_changes": _graph("SELECT label FROM n WHERE NOT resource AND p % 5 <> 4 AND p IN (SELECT p FROM affected)", _FILES, _TOUCHED, _AFFECTED),
        "g15_affected_index": _graph("SELECT label, coalesce(string_agg(file, ',' ORDER BY file), '') AS files FROM affected LEFT JOIN touched USING (p) JOIN n USING (p) GROUP BY label", _FILES, _TOUCHED, _AFFECTED),
        "g16_consumer_roots": _graph("SELECT label FROM n WHERE p IN (SELECT p FROM affected) AND p NOT IN (SELECT s FROM e WHERE t IN (SELECT p FROM affected))", _FILES, _TOUCHED, _AFFECTED),
        "g19_output_conflicts": _graph(
            """SELECT CASE WHEN x.type = 'oci' THEN 'image' ELSE 'same_path' END AS kind, least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, x.path, x.path AS other
              FROM o x JOIN o y ON x.path = y.path AND (x.type = 'oci') = (y.type = 'oci') AND x.p < y.p WHERE (x.p, y.p) NOT IN (SELECT a, p FROM up)
              UNION ALL SELECT 'inside_folder', least(x.label, y.label), greatest(x.label, y.label), x.path, y.path
              FROM o x JOIN o y ON x.p // 60 = y.p // 60 AND x.type = 'dir' AND y.type <> 'oci' AND starts_with(y.path, x.path || '/') WHERE (least(x.p, y.p), greatest(x.p, y.p)) NOT IN (SELECT a, p FROM up)""",
            """o AS (SELECT p, label, CASE WHEN p % 6 = 0 THEN 'dir' WHEN p % 6 = 2 THEN 'oci' ELSE 'file' END AS type,
              CASE WHEN p % 12 = 0 THEN 'shared/d' || (p // 60) || '/sub' WHEN p % 12 = 6 THEN 'shared/d' || (p // 60) WHEN p % 6 = 1 THEN 'shared/d' || (p // 60) || '/f' || (p // 30) || '.txt'
                WHEN p % 6 = 2 THEN 'img' || (p // 60) ELSE package || '/own' || p END AS path FROM n WHERE NOT resource)""",
            "up AS (SELECT t AS p, s AS a FROM e UNION SELECT p, s FROM up JOIN e ON t = a)"),
        "g20_constraints": _graph(
            f"""SELECT 'escaping_input' AS "check", label, '../up' || (p // 4) || '.txt' AS detail, 'error' AS severity FROM n WHERE NOT resource AND p % 111 = 0 AND p % 41 <> 0 AND p % 113 <> 0
              UNION ALL SELECT 'absolute_input', label, '/etc/x' || p, 'error' FROM n WHERE NOT resource AND p % 113 = 0 AND p % 41 <> 0
              UNION ALL SELECT 'absolute_output', label, '/abs' || p, 'error' FROM n WHERE NOT resource AND p % 31 = 0
              UNION ALL SELECT 'escaping_output', label, '../../../up' || p, 'error' FROM n WHERE NOT resource AND p % 37 = 0 AND p % 31 <> 0
              UNION ALL SELECT 'runs_once', label, label, 'warning' FROM n WHERE NOT resource AND p % 41 = 0
              UNION ALL SELECT 'push_without_image', label, 'img' || p, 'error' FROM n WHERE NOT resource AND p % 43 = 0 AND p % 86 <> 0
              UNION ALL SELECT 'test_without_command', label, label, 'error' FROM n WHERE NOT resource AND p % 80 = 0
              UNION ALL SELECT 'depends_on_test', {_LABEL('t')}, {_LABEL('s')}, 'error' FROM e WHERE s % 97 <> 0 AND s % 40 = 0 AND NOT (t % 97 <> 0 AND t % 40 = 0)
              UNION ALL SELECT 'depends_on_testonly', {_LABEL('t')}, {_LABEL('s')}, 'error' FROM e WHERE s % 97 <> 0 AND s % 40 <> 0 AND s % 17 = 0 AND t % 97 <> 0 AND t % 17 <> 0 AND t % 40 <> 0"""),
        "a10_duplicate_labels": _graph("""SELECT 'duplicate_label' AS "check", label, '2' AS detail, 'error' AS severity FROM n WHERE resource"""),
        "j4_missing_dependencies": _graph(f"""SELECT 'missing_dependency' AS "check", {_LABEL('t')} AS label, {_LABEL('s')} AS detail, 'error' AS severity FROM e WHERE s % 97 = 0"""),
        "g2_self_loops": _graph("SELECT label FROM n WHERE resource"),
        "g1_edges": _graph(f"SELECT {_LABEL('s')} AS src, {_LABEL('t')} AS dst FROM e WHERE t % 97 <> 0 UNION SELECT {_LABEL('1')}, label FROM n WHERE resource"),
        "g12_platform_error": _graph(
            f"""SELECT CAST(min(steps) AS INT) AS steps, label AS misfit, true AS said FROM (SELECT p, steps + 1 AS steps, {_LABEL('p')} AS label FROM need WHERE p % 13 = 0 AND p % 97 <> 0)
              WHERE label = (SELECT min({_LABEL('p')}) FROM need WHERE p % 13 = 0 AND p % 97 <> 0) GROUP BY label""",
            "need AS (SELECT s AS p, 1 AS steps FROM e WHERE t % 7 = 3 AND (t % 97 = 0 OR t % 13 <> 0) UNION SELECT s, steps + 1 FROM need JOIN e ON t = p)"),
        "g21_completions": _graph(
            """SELECT DISTINCT '//' || package AS completion FROM n WHERE starts_with(package, 'g3/p1') UNION SELECT label FROM n WHERE package = 'g3/p1'"""),
        "k5_mermaid": _graph(
            """SELECT 0::BIGINT AS place, 'flowchart TD' AS line UNION ALL SELECT k + 1, '    n' || k || '["' || label || '"]' FROM m
            UNION ALL SELECT (SELECT count(*) FROM m) + row_number() OVER (ORDER BY a.k, b.k), '    n' || a.k || ' --> n' || b.k FROM e JOIN m a ON a.p = t JOIN m b ON b.p = s""",
            "m AS (SELECT p, label, row_number() OVER (ORDER BY label) - 1 AS k FROM n)"),
        "k6_dependency_trees": _graph(
            "SELECT row_number() OVER (ORDER BY way) - 1 AS place, line FROM tree",
            "kids AS (SELECT t, s, n.label, n.label = max(n.label) OVER (PARTITION BY t) AS last FROM e JOIN n ON n.p = s)",
            "tree AS (SELECT p, [label] AS way, '' AS pad, label AS line FROM n WHERE p NOT IN (SELECT s FROM e) UNION ALL "
            "SELECT k.s, list_append(way, k.label), pad || CASE WHEN last THEN '    ' ELSE '│   ' END, pad || CASE WHEN last THEN '╰' ELSE '├' END || '── ' || k.label FROM tree JOIN kids k ON k.t = tree.p)"),
        "k4_graph_json": _graph(
            f"""SELECT {_LABEL('p')} AS label, '{{"label":"' || {_LABEL('p')} || '","dependencies":[' || coalesce((SELECT string_agg('"' || {_LABEL('s')} || '"', ',' ORDER BY {_LABEL('s')}) FROM e WHERE t = p), '') || ']}}' AS json FROM n"""),
        "x11_label_parts": _graph("SELECT label, package, name, p % 40 = 0 AS is_test, label AS short FROM n"),
        "x18_hashes": _graph(
            """SELECT label, sha256(array_to_string(list_sort(['src' || p || '.txt', CASE WHEN p % 111 = 0 THEN '../up' ELSE 'lib' END || (p // 4) || '.txt']), ',')) AS inputs_hash, 'size=' || p_size || ',type=' || p_type AS fingerprint_text FROM n"""),
        "i1_definition_hash": _graph(
            f"""SELECT label, sha256(label || command || array_to_string(list_sort(['src' || p || '.txt', CASE WHEN p % 111 = 0 THEN '../up' ELSE 'lib' END || (p // 4) || '.txt']), ',')
                || CASE WHEN p % 25 = 0 THEN array_to_string(list_sort([{_OUT}, 'bin' || p]), ',') ELSE {_OUT} END || 'size=' || p_size || ',type=' || p_type || 'linux/amd64') AS definition_hash
              FROM (SELECT *, CASE WHEN p % 80 = 0 THEN '' ELSE p_name END AS command FROM n)"""),
        "i10_failure_propagation": _graph("SELECT label, p NOT IN (9, 50) AS is_success FROM n WHERE p NOT IN (SELECT p FROM hit)", "hit AS (SELECT t AS p FROM e WHERE s IN (9, 50) UNION SELECT t FROM hit JOIN e ON s = p)"),
        "a4_completion_counts": _traces("SELECT count(*) FILTER (status = 'SUCCESS') AS success_count, count(*) FILTER (status = 'SUCCESS' AND cache_result = 'CACHE_HIT') AS cache_hit_count, count(*) FILTER (status <> 'SUCCESS') AS error_count FROM spans"),
        "k11_new_content": _traces("SELECT DISTINCT output_hash AS digest FROM spans WHERE NOT starts_with(output_hash, '1')"),
        "k12_latest_results": _traces("SELECT change_hash, max(start_time_unix_millis * 1000 + CAST(trace_id AS BIGINT)) AS version FROM spans GROUP BY change_hash"),
        "j10_pull_keys": _traces("SELECT DISTINCT trace_id AS key FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM builds WHERE failure_count > 0)"),
        "a9_outputs_by_tag": _graph(
            f"SELECT tag, string_agg(DISTINCT out, ',' ORDER BY out) AS outputs FROM (SELECT unnest(['tag' || (p % 5), p_brand]) AS tag, {_OUT} AS out FROM n WHERE p IN (SELECT p FROM walk)) GROUP BY tag",
            "walk AS (SELECT s AS p FROM e WHERE t = 199 UNION SELECT s FROM walk JOIN e ON t = p)"),
    }
    out |= _more()
    ranked = [
        f"""SELECT '{name}' AS category, row_number() OVER (ORDER BY {metric} DESC, label) AS place, label FROM (SELECT * FROM measures WHERE {where} ORDER BY impact DESC, label LIMIT 10)"""
        for name, (metric, where) in _CATEGORY.items()
    ]
    out["k8_ranked_categories"] = _BOTTLENECKS + " UNION ALL ".join(ranked)
    for name, (metric, where) in _CATEGORY.items():
        columns = "label, n, impact" + ("" if name == "impact" else f", {metric}")
        out[f"l6_bottleneck_{name}"] = _BOTTLENECKS + f"SELECT {columns} FROM (SELECT * FROM measures WHERE {where} ORDER BY impact DESC, label LIMIT 10)"
    return out


_STATUS = "CASE WHEN p % 9 <> 0 THEN 'SUCCESS' WHEN p % 18 = 0 THEN 'FAILURE' ELSE 'CANCELLED' END"
_ASSEMBLED = f"""assembled AS (
  SELECT label, {_STATUS} AS status, CASE WHEN p % 9 <> 0 AND p % 2 = 0 THEN 'CACHE_HIT' ELSE 'CACHE_MISS' END AS cache_result, {' + '.join(f'p % {k + 2}' for k in range(8))} AS total_duration_millis, p,
    p % 40 = 0 AS is_test, 'tag' || (p % 5) || ',' || p_brand AS tags FROM n WHERE NOT resource)"""
_LONG = "repeat(command || ' é', 12) || chr(10) || 'second line'"


def _prefixed(*values: str) -> str:
    return " || ".join(f"octet_length(encode({v})) || ':' || {v}" for v in values)


def _more() -> dict[str, str]:
    return {
        "x5_text_forms": _traces(
            """SELECT trace_id, label, start_time_unix_millis, CASE WHEN t < 1000 THEN t || 'ms' ELSE (t // 1000) || '.' || (t // 100 % 10) || 's' END AS total, (queue_wait_millis % 1000) || 'ms' AS queue,
              CASE status WHEN 'SUCCESS' THEN 'ok' ELSE 'FAIL' END AS status, CASE cache_result WHEN 'CACHE_HIT' THEN 'hit' ELSE 'miss' END AS cache, CASE WHEN t > 10000 THEN 'high' WHEN t > 3000 THEN 'medium' ELSE 'low' END AS band,
              start_time_unix_millis || '000000' AS nanos, strftime(make_timestamp(start_time_unix_millis * 1000), '%Y-%m-%d') AS day FROM (SELECT *, total_duration_millis // 100 * 100 AS t FROM spans)"""),
        "x13_command_texts": f"""SELECT command, CASE WHEN length(line) > 70 THEN left(line, 67) || '...' ELSE line END AS shown, CAST(CASE WHEN torn THEN 63 ELSE 64 END AS INT) AS bytes, regexp_replace(long, '[^A-Za-z0-9._-]', '', 'g') AS sanitised
            FROM (SELECT *, split_part(long, chr(10), 1) AS line, (SELECT max(cut) FROM (SELECT octet_length(encode(left(long, k))) = 63 AND octet_length(encode(left(long, k + 1))) = 65 AS cut FROM range(1, 64) AS r(k))) AS torn
              FROM (SELECT command, {_LONG} AS long FROM (SELECT DISTINCT 'make ' || l_partkey AS command FROM lineitem)))""",
        "x15_paths": f"""SELECT p AS part, path, path = '..' OR starts_with(path, '../') AS escapes, path = 'e' OR starts_with(path, 'e/') AS inside
            FROM (SELECT p, CASE WHEN p % 3 = 1 THEN '../' ELSE '' END || CASE WHEN p % 2 = 0 THEN 'e/f' ELSE 'd' || (p % 10) || '/g/h' END AS path FROM (SELECT p_partkey AS p FROM part))""",
        "x16_outputs": """SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN 'oci' WHEN 1 THEN 'dir' ELSE 'file' END AS type, p_name AS identifier, CASE p_partkey % 3 WHEN 0 THEN 'oci::' WHEN 1 THEN 'dir::' ELSE '' END || p_name AS text FROM part""",
        "x20_resource_identity": _graph(f"SELECT p AS part, left(sha256({_prefixed('label', 'p_name', chr(39) + 'stop' + chr(39), chr(39) * 2, chr(39) + '5m0s' + chr(39), chr(39) + '1' + chr(39), chr(39) + '//:db' + chr(39), chr(39) + '2' + chr(39), chr(39) + 'BRAND' + chr(39), 'p_brand', chr(39) + 'TYPE' + chr(39), 'p_type')}), 12) AS identity FROM n"),
        "j9_aliases": """WITH RECURSIVE n AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 97 = 0 THEN 'resource' WHEN p_partkey < 50 THEN 'target' ELSE 'alias' END AS kind FROM part),
            walk AS (SELECT p AS head, p AS here FROM n UNION ALL SELECT head, here // 2 FROM walk JOIN n ON p = here WHERE kind = 'alias')
            SELECT CAST(head AS VARCHAR) AS label, CASE WHEN kind = 'target' THEN CAST(here AS VARCHAR) END AS target FROM walk JOIN n ON p = here WHERE kind <> 'alias'""",
        "j21_tool_paths": _graph(
            f"""SELECT unnest(CASE WHEN package = (SELECT package FROM n WHERE p = 150) THEN [label, ':' || name] ELSE [label] END) AS name, CASE WHEN p % 25 = 0 THEN 'bin' || p END AS "binary", {_OUT} AS outputs
              FROM n WHERE p IN (SELECT s FROM e WHERE t = 150)"""),
        "s11_expand_inputs": _graph(
            """SELECT DISTINCT a.label, f.input FROM n a JOIN (SELECT package, 'src' || p || '.txt' AS input FROM n WHERE NOT resource) f ON f.package = a.package
              WHERE NOT a.resource AND starts_with(f.input, 'src1') AND length(f.input) <> 9 UNION SELECT label, 'plain' FROM n WHERE NOT resource"""),
        "i13_assembled_spans": _graph("SELECT label, status, cache_result, total_duration_millis, p + total_duration_millis AS end_time_unix_millis, is_test, tags FROM assembled", _ASSEMBLED),
        "i13_assembled_build": _graph("SELECT count(*) AS total_targets, count(*) FILTER (status = 'SUCCESS') AS success_count, count(*) FILTER (status = 'FAILURE') AS failure_count, count(*) FILTER (status = 'SUCCESS' AND cache_result = 'CACHE_HIT') AS cache_hit_count FROM assembled", _ASSEMBLED),
        "i3_content_hashes": _graph("SELECT label, sha256(array_to_string(list_sort(files), '')) AS content_hash FROM n WHERE NOT resource"),
        "g10_cycle": _graph(
            f"""SELECT w.place - f.place AS place, {_LABEL('w.p')} AS label FROM walk w, (SELECT b.place AS until, a.place AS place FROM walk a JOIN walk b ON a.p = b.p AND a.place < b.place ORDER BY b.place, a.place LIMIT 1) f
              WHERE w.place BETWEEN f.place AND f.until""",
            "behind AS (SELECT 2 AS p UNION SELECT t FROM behind JOIN e ON s = p)", "before AS (SELECT 64 AS p UNION SELECT s FROM before JOIN e ON t = p)",
            "core AS (SELECT p FROM behind INTERSECT SELECT p FROM before)", "ring AS (SELECT s, t FROM e WHERE s IN (SELECT p FROM core) AND t IN (SELECT p FROM core) UNION ALL SELECT 64, 2)",
            f"onward AS (SELECT s, arg_min(t, {_LABEL('t')}) AS t FROM ring GROUP BY s)",
            f"walk AS (SELECT CAST(0 AS BIGINT) AS place, arg_min(p, {_LABEL('p')}) AS p FROM core UNION ALL SELECT place + 1, t FROM walk JOIN onward ON s = p WHERE place <= (SELECT count(*) FROM core))"),
        "i4_early_cutoff": _graph(
            f"""SELECT {_LABEL('head')} AS label, CAST(max(depth) AS INT) AS level, head % 5 <> 0 AND head NOT IN (SELECT t FROM e WHERE s % 10 = 0 AND s % 97 <> 0) AS hit
              FROM down WHERE head % 97 <> 0 GROUP BY head""", _WEIGHED, _DOWN),
        "i4_delta": _graph(
            f"""SELECT {_LABEL('head')} AS label, CAST(max(depth) AS INT) AS level, head % 5 <> 0 AND head NOT IN (SELECT t FROM e WHERE s % 10 = 0 AND s % 97 <> 0) AS hit,
              sha256(CASE WHEN head % 10 = 0 THEN 'new' ELSE 'out' END || {_LABEL('head')}) AS output_hash, head % 10 = 0 AS moved
              FROM down WHERE head % 97 <> 0 AND (head % 5 = 0 OR head IN (SELECT t FROM e WHERE s % 10 = 0 AND s % 97 <> 0)) GROUP BY head""", _WEIGHED, _DOWN),
        "i5_folder_digests": _FOLDERS + " SELECT * FROM d3 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d0",
        "i7_no_cache_hashes": _FOLDERS + """ SELECT '//:' || root AS label, sha256(array_to_string(list_sort([digest, first]), ',')) AS output_hash
            FROM d0 JOIN (SELECT root, arg_min(sha256(p_name), CASE WHEN folder = '' THEN name ELSE folder || '/' || name END) AS first FROM entries WHERE NOT link GROUP BY root) USING (root)""",
        "i8_hits": """SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, '//s' || (l_suppkey % 10) || ':t' || l_suppkey AS label, epoch_ms(l_shipdate) + l_linenumber * 1000 AS start_time_unix_millis,
            l_linestatus <> 'O' AND l_linenumber <> 1 AND l_returnflag <> 'R' AS hit FROM lineitem""",
    }

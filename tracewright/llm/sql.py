"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = f"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents
), grouped AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, h.text_sha256
FROM hashed h JOIN grouped g USING (text_sha256)
"""

#: Waterfilling: sources by the level at which they are full; the first place whose level is below its own fill level.
_MIX = f"""
rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS key
  FROM {{documents}}
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][i % 3 + 1] AS DOUBLE) AS weight, CAST([-0.5, 0, 0.5][i % 3 + 1] AS DOUBLE) AS slope
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM sizes)
), filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fills_at FROM weighed
), running AS (
  SELECT *, row_number() OVER o AS place,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
         sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS weights
  FROM filled WINDOW o AS (ORDER BY fills_at, source ASC NULLS LAST)
), levels AS (
  SELECT *, (budget - cap_before) / (weights - weight_before) AS level FROM running
), found AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level <= fills_at
), plan AS (
  SELECT l.source, source_size, slope, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, weight * f.level) END AS target
  FROM levels l CROSS JOIN found f
), placed AS (
  SELECT r.*, p.source_size, p.target, p.slope,
         CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
), mixed AS (
  SELECT *, CAST(greatest(0, least(size, round(target) - first)) + greatest(0, least(size, round(target) - source_size - first)) AS BIGINT) AS taken,
         CASE WHEN size > 0 AND first < round(target) THEN first / target END AS share,
         CASE WHEN size > 0 AND source_size + first < round(target) THEN (source_size + first) / target END AS share_again
  FROM placed
)"""
_POSITION = lambda share: f"CASE WHEN slope = 0 THEN {share} ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * {share}) - (1 - slope)) / (2 * slope) END"

MIXING = f"WITH {_MIX.format(documents='documents')} SELECT doc_id, size, source_size, target, taken, {_POSITION('share')} AS position, {_POSITION('share_again')} AS again FROM mixed"


#: Each of these strings gets one more character when it is escaped, as does a backslash.
_CONTROL = r"\\|<\||</?s>|<(start|end)_of_turn>|<(bos|eos|unk|pad)>|<</?SYS>>|\[/?(INST|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\]"

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(k, r)
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(12 + length(role) + len(regexp_extract_all(role, '{_CONTROL}|' || chr(10))) + 1 + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + 11) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM whole
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hexed, {5 * k + 1}, 5) AS BIGINT) >> {shift}) & 31)::INT, 1)" for k in range(8) for shift in (15, 10, 5, 0))

WARC = f"""
WITH hashed AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages
), digests AS (
  SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM hashed
), last AS (
  SELECT payload_digest, max(page_id) AS winner FROM digests GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM digests JOIN last USING (payload_digest)
"""


def _url_filter(depth: int = 8) -> str:
    """The tables' paths have up to 4 segments; so many levels are written out, the operator itself goes to the end."""
    ctes = [
        r"""parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parsed
), urls AS (
  SELECT DISTINCT host, path, CAST(rule IS NOT NULL AS INT) AS labelled, CAST(coalesce(rule IN ('org/', 'com/fr/'), false) AS INT) AS good FROM ruled
), level0 AS (
  SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS segments, '' AS template, '' AS parent, false AS literal FROM urls
)"""
    ]
    for k in range(depth):
        ctes.append(
            f"""wide{k} AS (
  SELECT host, template FROM (SELECT host, template, segments[{k + 1}] AS segment, count(*) AS urls FROM level{k} WHERE len(segments) > {k} GROUP BY ALL)
  GROUP BY host, template HAVING count(*) >= 12 AND count(*) >= CAST(0.2 AS DOUBLE) * sum(urls)
), here{k} AS (
  SELECT l.*, len(segments) > {k} AS there, segments[{k + 1}] AS segment,
         len(segments) > {k} AND (regexp_matches(segments[{k + 1}], '[0-9]') OR length(segments[{k + 1}]) >= 24 OR w.host IS NOT NULL) AS made
  FROM level{k} l LEFT JOIN wide{k} w ON l.host = w.host AND l.template = w.template
), level{k + 1} AS (
  SELECT host, path, labelled, good, segments, CASE WHEN NOT there THEN template WHEN made THEN template || '/*' ELSE template || '/' || segment END AS template,
         CASE WHEN NOT there THEN parent WHEN made THEN parent || '/*' ELSE template || '/*' END AS parent, literal OR (there AND NOT made) AS literal
  FROM here{k}
)"""
        )
    ctes.append(
        f"""found AS (
  SELECT host, path, labelled, good, template || tail AS template, CASE WHEN literal THEN parent || tail ELSE template || tail END AS parent
  FROM (SELECT *, CASE WHEN len(segments) > {depth} THEN '/**' ELSE '' END AS tail FROM level{depth})
), own AS (
  SELECT host, template, parent, sum(labelled) AS labelled, sum(good) AS good FROM found GROUP BY ALL
), pool AS (
  SELECT host, parent, sum(labelled) AS pool_labelled, sum(good) / nullif(sum(labelled), 0) AS rate FROM own GROUP BY ALL
), alike AS (
  SELECT own.*, CASE WHEN labelled = 0 OR abs(good - labelled * rate) <= CAST(1.96 AS DOUBLE) * sqrt(labelled * rate * (1 - rate)) THEN own.parent ELSE template END AS merged
  FROM own JOIN pool ON own.host = pool.host AND own.parent = pool.parent
), branch AS (
  SELECT host, merged, sum(labelled) AS bl, sum(good) AS bg FROM alike GROUP BY ALL
), everywhere AS (
  SELECT template, sum(labelled) AS al, sum(good) AS ag FROM own GROUP BY ALL
), base AS (
  SELECT (sum(good) + 1) / (sum(labelled) + 2) AS base FROM own
), scored AS (
  SELECT a.host, a.template, a.merged, (bg + 4 * ((ag + 4 * base) / (al + 4))) / (bl + 4) AS purity
  FROM alike a JOIN branch b ON a.host = b.host AND a.merged = b.merged JOIN everywhere e ON a.template = e.template CROSS JOIN base
)"""
    )
    return (
        "WITH " + ", ".join(ctes) + """
SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN r.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block' WHEN s.purity >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, s.merged AS template, s.purity
FROM ruled r JOIN found f ON r.host = f.host AND r.path = f.path JOIN scored s ON f.host = s.host AND f.template = s.template
"""
    )


_BIT = "(1 << (strpos('ABCDE', f) - 1))"

FILTER_AUDIT = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), marked AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > first THEN 16 ELSE 0 END AS mask
  FROM texts t JOIN firsts USING (text) LEFT JOIN marked USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f,
         list_sum([0] || list_transform(range(1, step), lambda k: 1 << (strpos('ABCDE', substr(filter_order, k, 1)) - 1))) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), found AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN mask & (CAST(before AS INT) | {_BIT}) = 0 THEN docs ELSE 0 END) AS kept,
         sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & {_BIT} <> 0 THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN mask & CAST(before AS INT) <> 0 AND mask & {_BIT} <> 0 THEN docs ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = {_BIT} THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & {_BIT} <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & {_BIT} <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _url_filter(), "op3_exact_dedup": EXACT_DEDUP, "op4_chat_format": CHAT, "op6_arc_to_warc": WARC, "op7_mix_curriculum": MIXING, "op11_filter_audit": FILTER_AUDIT}

"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from foliant.llm import decontaminate, secrets

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: str, pattern: str, group: int, least: int, most: int | None, role: str) -> str:
    rank = [k[0] for k in secrets.KINDS].index(kind)
    size = f"length(hits[i].v) >= {least}" if most is None else f"length(hits[i].v) BETWEEN {least} AND {most}"
    return f"""
    SELECT rid, {rank} AS rank, '{kind}' AS kind, '{role}' AS role, s AS "start", s + length(hits[i].h) AS "end"
    FROM (
      SELECT rid, hits, i, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x.h))), 0))::BIGINT AS s
      FROM (
        SELECT rid, string_split_regex(text, {_quoted(pattern)}) AS gaps,
          list_transform(list_zip(regexp_extract_all(text, {_quoted(pattern)}, 0), regexp_extract_all(text, {_quoted(pattern)}, {group})), lambda z: {{'h': z[1], 'v': z[2]}}) AS hits
        FROM d) q, unnest(range(1, len(hits) + 1)) AS u(i)) p
    WHERE {size}"""


def _near(role: str) -> str:
    order = '(o."start", o.rank) < (s."start", s.rank)'
    return f"""EXISTS (SELECT 1 FROM spans o WHERE o.rid = s.rid AND o.role = '{role}' AND
      (({order} AND s."start" - o."end" <= {secrets.SCOPE}) OR ((o."start", o.rank) > (s."start", s.rank) AND o."start" - s."end" <= {secrets.SCOPE})))"""


SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_spans(*k) for k in secrets.KINDS)}),
kept AS (
  SELECT * FROM spans s WHERE s.kind IN ('assign', 'access', 'hex') OR (
    CASE s.kind WHEN 'secret' THEN {_near("id")} WHEN 'id' THEN {_near("secret")} ELSE {_near("id")} AND {_near("secret")} END
    AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.rid = s.rid AND o.kind IN ('assign', 'access', 'hex') AND
      (((o."start", o.rank) < (s."start", s.rank) AND o."end" > s."start") OR ((o."start", o.rank) > (s."start", s.rank) AND o."start" < s."end"))))),
summed AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
    string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) AS spans
  FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (rid)
"""

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{decontaminate.WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS span FROM (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{decontaminate.WORD}') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, span, array_to_string(w[i:i + span - 1], ' ') AS win FROM b, unnest(range(1, len(w) - span + 2)) AS t(i)),
dw AS (SELECT rid, span, i, array_to_string(w[i:i + span - 1], ' ') AS win FROM d, (SELECT DISTINCT span FROM b) s, unnest(range(1, len(w) - span + 2)) AS t(i)),
hits AS (SELECT rid, i, dw.span, item_id FROM dw JOIN bw ON dw.span = bw.span AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, span FROM hits) h, unnest(range(i, i + span)) AS u(p) GROUP BY rid),
its AS (SELECT rid, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from papyra.llm import urlfilter

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text,
    '(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>|\|[a-z_]{1,24}\|>|(?:image|audio|document|other):[0-9]+>)', '\1\\\2\3', 'g') AS safe
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(9 + length(role) + length(safe)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _url_sql() -> str:
    def term(w: str) -> str:
        return f"CAST(regexp_matches(low, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') AS INT)"

    def fits(host: str, path: str) -> str:
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"

    by_length = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in by_length)
    ruled = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in by_length)
    strict = " + ".join(term(w) for w in urlfilter.STRICT)
    soft = " + ".join(term(w) for w in urlfilter.SOFT)
    return f"""
WITH u AS (
  SELECT page_id, url, translate(coalesce(url, ''), {_AZ}) AS low,
    strpos(coalesce(url, ''), '://') AS pos FROM pages
), p AS (
  SELECT *, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {ruled} WHEN ({strict}) >= 1 OR ({soft}) >= {urlfilter.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM h
"""


DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL = {"op5_chat_format": CHAT, "op7_url_filter": _url_sql(), "op10_decontaminate": DECONTAMINATE}

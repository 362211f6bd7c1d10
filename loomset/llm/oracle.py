"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from loomset.llm.quality_rules import STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = r"[\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op1_mixture"] = rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM docs GROUP BY source
), steps AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0) AS capped,
    sum(w) OVER (ORDER BY source_size / w DESC, source NULLS LAST) AS free_w
  FROM sources
  WINDOW before AS (ORDER BY source_size / w, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT cap / w AS ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - capped) / free_w AS level FROM steps
), level AS (
  SELECT max(level) AS level FROM levels WHERE level <= ratio
), goals AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM level), 0) * w) AS target FROM steps
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / (1::BIGINT << 52)::DOUBLE
    < rate - floor(rate))::INT))::BIGINT AS taken
FROM rated
"""

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

SQL["op5_quality_rules"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws
  FROM documents
), starts AS (
  SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM docs WHERE len(ws) >= 8
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 7], ' ')) AS n FROM starts
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM windows, range(8) AS offsets(k) WHERE n > 1 GROUP BY rid
), lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM docs
), counts AS (
  SELECT doc_id, len(ws) AS n_words,
    length(regexp_replace(text, '{_BLANKS}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•|]'))) AS n_bullets,
    coalesce(n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echoes
  FROM docs JOIN lines USING (rid) LEFT JOIN repeated USING (rid)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 1.5 * n_words AND 25 * n_words AND n_symbols <= 0.25 * n_words
  AND n_dup_lines <= 0.5 * n_lines AND n_bullets <= 0.9 * n_lines AND n_echoes <= 0.4 * n_words
  AND (n_words < 40 OR n_stop_words >= 0.01 * n_words) AS kept
FROM judged
"""

SQL["op3_perspectives"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(name, ''), 'unknown') AS who, system,
    replace(coalesce(text, ''), '<|', '< |') AS body
  FROM (SELECT *, coalesce(trim(role) = 'system', false) AS system,
    trim(regexp_replace(replace(coalesce(role, ''), '<|', '< |'), '[\x0A-\x0D\x{85}\x{2028}\x{2029}]+', ' ', 'g')) AS name
    FROM conversations)
), people AS (
  SELECT DISTINCT conv_id, who AS participant FROM turns WHERE NOT system
), views AS (
  SELECT t.*, participant,
    CASE WHEN system THEN 'system' WHEN who = participant THEN 'assistant' ELSE 'user' END AS chat_role
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), heads AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN who END AS name,
    '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || who ELSE '' END || chr(10) AS head
  FROM views
), shown AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM heads
), placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (
    PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, who, body
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM shown
)
SELECT conv_id, participant, turn, chat_role, name, rendered, start,
  CASE WHEN chat_role = 'assistant' THEN start + length(head) END AS mask_start,
  CASE WHEN chat_role = 'assistant' THEN start + length(rendered) - 1 END AS mask_end
FROM placed
"""

_KEPT = """
SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""


def _lloyd(rounds: int) -> str:
    """Rounds of assigning and averaging, each a few common table expressions."""
    nearest = """
SELECT k.vec_id, k.v,
  arg_min(c.cluster, (list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))), c.cluster)) AS cluster
FROM kept k, centroids{n} c GROUP BY k.rid, k.vec_id, k.v
"""
    parts = [f"kept AS (SELECT row_number() OVER () AS rid, * FROM ({_KEPT}))"]
    parts.append(
        "centroids0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v FROM kept "
        "QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16)"
    )
    for n in range(rounds):
        parts.append(f"assigned{n} AS ({nearest.format(n=n)})")
        parts.append(
            f"sums{n} AS (SELECT cluster, i, sum(v[i])::HUGEINT AS s, count(*) AS c "
            f"FROM assigned{n}, range(1, 65) AS t(i) GROUP BY cluster, i)"
        )
        exact = "s // c - CASE WHEN s % c < 0 THEN 1 ELSE 0 END"
        parts.append(f"means{n} AS (SELECT cluster, list(({exact})::BIGINT ORDER BY i) AS v FROM sums{n} GROUP BY cluster)")
        parts.append(
            f"centroids{n + 1} AS (SELECT o.cluster, coalesce(m.v, o.v) AS v FROM centroids{n} o LEFT JOIN means{n} m USING (cluster))"
        )
    parts.append(f"last AS ({nearest.format(n=rounds)})")
    return f"""
WITH {", ".join(parts)}
, measured AS (
  SELECT l.vec_id, l.cluster::INT AS cluster, sha256(array_to_string(c.v, ',')) AS centroid_sha256,
    list_sum(list_transform(range(1, 65), lambda i: (l.v[i] - c.v[i]) * (l.v[i] - c.v[i])))::BIGINT AS distance
  FROM last l JOIN centroids{rounds} c USING (cluster)
)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM measured
"""


SQL["op12_va_file"] = _lloyd(3)

"""Standard SQL with the same results as the registered queries, for DuckDB."""

from __future__ import annotations

from loomset.functions.ratings import ADVICE
from loomset.functions.text import WHITESPACE
from loomset.operators.dialogues import ASSISTANT_LABEL, USER_LABEL
from loomset.operators.formats import FORMAT_NAMES
from loomset.plans.prepare import SYSTEM_PROMPT

_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_NL = "chr(10)"


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[\\s\\x0b]+'), lambda w: w <> '')"


def _key(identity: str) -> str:
    return f"md5('42:' || {identity})"


def _block(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || {_NL} || {content} || '<|im_end|>'"


def _chat(prompt: str, answer: str) -> str:
    turns = (
        _block("system", f"'{SYSTEM_PROMPT}'"),
        _block("user", prompt),
        _block("assistant", answer),
    )
    return f" || {_NL} || ".join(turns)


def _reason(t: str) -> str:
    solid = f"replace(replace(replace({t}, {_NL}, ''), ' ', ''), chr(9), '')"
    return (
        f"CASE WHEN {t} = '' THEN 'empty' "
        f"WHEN length({t}) < 10 OR length({t}) > 8192 THEN 'length' "
        f"WHEN length({solid}) < 5 THEN 'blank' END"
    )


_STRIPPED = f"SELECT doc_id, {_strip('text')} AS text FROM documents"

_EXCHANGES = """
SELECT a.conv_id, a.turn, u.text AS prompt, a.text AS response
FROM conversations a JOIN conversations u
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE a.role = 'assistant' AND u.role = 'user'
"""

_ALPACA_PAIRS = f"SELECT lang || {_NL} || source AS prompt, text AS response FROM documents"


def _split(rows: str, columns: str) -> str:
    """First max(1, int(5 %)) rows by order_key are 'val'."""
    return f"""
    SELECT {columns}, CASE WHEN place <= greatest(1, trunc(n * 0.05::DOUBLE)) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY order_key) AS place, count(*) OVER () AS n FROM ({rows}))
    """


def _first_of_prefix(rows: str) -> str:
    return f"""
    SELECT * EXCLUDE (dup) FROM (
      SELECT *, row_number() OVER (PARTITION BY left(text, 200) ORDER BY order_key) AS dup FROM ({rows})
    ) WHERE dup = 1
    """


_CLEAN_DOCUMENTS = _first_of_prefix(
    f"SELECT doc_id, text, {_key('doc_id')} AS order_key FROM ({_STRIPPED}) WHERE ({_reason('text')}) IS NULL"
)

_CONTEXTS = f"""
SELECT conv_id, turn, text, p FROM (
  SELECT conv_id, turn, role, text,
         string_agg(line, {_NL}) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM (SELECT *, CASE role WHEN 'user' THEN '{USER_LABEL}' ELSE '{ASSISTANT_LABEL}' END || text AS line
        FROM conversations WHERE role IN ('user', 'assistant'))
) WHERE role = 'assistant' AND p IS NOT NULL
"""

_EXPANDED = f"""
SELECT conv_id, turn, p AS prompt, text AS response, false AS over_length
FROM ({_CONTEXTS})
"""

_NESTED = f"""
SELECT doc_id, i - 1 AS turn_pos, p AS prompt, l[i] AS response, false AS over_length
FROM (SELECT doc_id, l, i, array_to_string(list_transform(l[1:i - 1], lambda x, j:
        CASE WHEN j % 2 = 1 THEN '{USER_LABEL}' ELSE '{ASSISTANT_LABEL}' END || x), {_NL}) AS p
      FROM (SELECT doc_id, l, unnest(range(2, len(l) + 1, 2)) AS i
            FROM (SELECT doc_id, string_split(text, {_NL}) AS l FROM documents)))
"""

_TURN_TEXT = f"""
SELECT *, {_strip(_chat('prompt', 'response'))} AS text,
       {_key("(conv_id || '-' || turn)")} AS order_key
FROM ({_EXPANDED}) WHERE prompt IS NOT NULL
"""

_CLEAN_TURNS = _first_of_prefix(f"SELECT * FROM ({_TURN_TEXT}) WHERE ({_reason('text')}) IS NULL")


def _prepared_turns(text: str, kept: str) -> str:
    rows = f"SELECT *, {_strip(text)} AS text, {_key("(conv_id || '-' || turn)")} AS order_key FROM ({_EXPANDED})"
    clean = _first_of_prefix(f"SELECT * FROM ({rows}) WHERE {kept}")
    return _split(clean, "conv_id, turn, prompt, text")


_FORMAT_OF_SOURCE = """
CASE source WHEN 'src0' THEN 'alpaca' WHEN 'src1' THEN 'sharegpt' WHEN 'src2' THEN 'chatml'
 WHEN 'src3' THEN 'cot' WHEN 'src4' THEN 'plain_text' ELSE 'general_json' END
"""

_SHOWN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMAT_NAMES.items())

_RECORD_JSON = """
CASE source
 WHEN 'src0' THEN json_object('instruction', lang, 'input', source, 'output', text)::VARCHAR
 WHEN 'src1' THEN json_object('conversations', [
   json_object('from', 'human', 'value', lang), json_object('from', 'gpt', 'value', text)])::VARCHAR
 WHEN 'src2' THEN json_object('messages', [
   json_object('role', 'system', 'content', lang), json_object('role', 'user', 'content', source),
   json_object('role', 'assistant', 'content', text)])::VARCHAR
 WHEN 'src3' THEN json_object('Question', source, 'Complex_CoT', text, 'Response', lang)::VARCHAR
 WHEN 'src4' THEN json_object('text', text)::VARCHAR
 WHEN 'src5' THEN json_object('query', source, 'answer', text, 'content', lang)::VARCHAR
 ELSE json_object('content', text, 'q', source)::VARCHAR END
"""

_METRICS = """
SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'train/loss' WHEN 'purchase' THEN 'eval/loss'
  WHEN 'signup' THEN 'train/learning_rate' ELSE 'loss' END AS tag, event_id AS step, value
FROM events
"""

_TRAIN = f"""
SELECT run_id, step, value FROM (
  SELECT *, max(CASE WHEN tag = 'train/loss' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id) AS named
  FROM ({_METRICS})
) WHERE tag = CASE WHEN named = 1 THEN 'train/loss' ELSE 'loss' END
"""


def _orthogonal_fit() -> str:
    """Least squares by orthogonal polynomials (three-term recurrence), degree by point count."""
    ctes = [
        """
    base AS (
      SELECT run_id, step, value AS y, n, CASE WHEN n > 4 THEN least(5, n - 1) ELSE least(3, greatest(1, n - 1)) END AS d,
             (step - (lo + hi) / 2.0) / greatest((hi - lo) / 2.0, 1.0) AS x
      FROM (SELECT user_id AS run_id, event_id AS step, value, count(*) OVER w AS n,
                   min(event_id) OVER w AS lo, max(event_id) OVER w AS hi
            FROM events WINDOW w AS (PARTITION BY user_id))
    ),
    k0 AS (SELECT *, 1.0::DOUBLE AS q, 0.0::DOUBLE AS qb, 1.0::DOUBLE AS sb, 0.0::DOUBLE AS f FROM base)"""
    ]
    for k in range(6):
        ctes.append(
            f"""
    s{k} AS (SELECT *, sum(q * q) OVER w AS s, sum(y * q) OVER w AS yq, sum(x * q * q) OVER w AS xq
             FROM k{k} WINDOW w AS (PARTITION BY run_id)),
    k{k + 1} AS (SELECT run_id, step, y, n, d, x,
               CASE WHEN s > 1e-9 THEN (x - xq / s) * q - CASE WHEN {k} > 0 AND sb > 1e-9 THEN s / sb ELSE 0 END * qb ELSE 0 END AS q,
               q AS qb, s AS sb, f + CASE WHEN {k} <= d AND s > 1e-9 THEN yq / s * q ELSE 0 END AS f
             FROM s{k})"""
        )
    return "WITH " + ",".join(ctes)


_REQUEST = "user_id || '-' || strftime(ts, '%Y%m%d')"
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"

_REQUESTS = f"""
SELECT {_REQUEST} AS request_id, date_trunc('day', ts)::TIMESTAMP AS start_ts, max(ts) AS end_ts,
       CAST(max({_K}) AS BIGINT) AS input_tokens
FROM events GROUP BY ALL
"""

_SAMPLE_COLUMNS = f"""
ts, value AS cpu, {_K} / 10 AS system_memory,
CASE WHEN event_type <> 'error' THEN {_K} / 8 END AS pytorch_allocated,
CASE WHEN event_type <> 'error' THEN {_K} / 8 END AS gpu_memory_allocated,
CASE WHEN event_type <> 'signup' THEN {_K} END AS gpu_usage,
CASE WHEN event_type = 'click' THEN value END AS gpu_temp,
CASE WHEN event_type = 'view' THEN value * 2 END AS gpu_power,
CASE WHEN event_type <> 'view' THEN {_K} / 7 END AS gpu_memory_used
"""

_SAMPLES = f"SELECT {_REQUEST} AS request_id, {_SAMPLE_COLUMNS} FROM events"

_BASELINE = f"""
SELECT request_id, start_ts, input_tokens / 40 AS system_memory_used,
       input_tokens / 20 AS gpu_memory_allocated, input_tokens / 5 AS gpu_memory_total
FROM ({_REQUESTS})
"""

_BUCKETED = """
    SELECT doc_id, n_real, greatest((n_real + 63) // 64, 1) * 64 AS width
    FROM (SELECT doc_id, least(octet_length(encode(text)), 2048) AS n_real FROM documents)
"""

_SPEED_NAMES = (
    "total_inference_time", "first_token_latency", "pure_generation_time", "total_inference_speed",
    "overall_processing_speed", "pure_generation_speed", "response_speed", "real_time_avg_speed",
)


def _speeds(sessions: str) -> str:
    """Speed columns from request_id, start_ts, end_ts, input_tokens, output_tokens, first_ts, last_ts, n_times."""
    return f"""
    SELECT request_id, total AS total_inference_time, first_lat AS first_token_latency, gen AS pure_generation_time,
           input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens,
           CASE WHEN total > 0 THEN output_tokens / total END AS total_inference_speed,
           CASE WHEN total > 0 THEN (input_tokens + output_tokens) / total END AS overall_processing_speed,
           CASE WHEN gen > 0 AND output_tokens > 1 THEN (output_tokens - 1) / gen END AS pure_generation_speed,
           CASE WHEN gen > 0 AND output_tokens > 1 THEN (output_tokens - 1) / gen END AS response_speed,
           CASE WHEN n_times > 1 THEN (n_times - 1) / ((epoch_us(last_ts) - epoch_us(first_ts)) / 1e6) END AS real_time_avg_speed
    FROM (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS total,
                 coalesce((epoch_us(first_ts) - epoch_us(start_ts)) / 1e6, 0) AS first_lat,
                 coalesce((epoch_us(end_ts) - epoch_us(first_ts)) / 1e6, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6) AS gen
          FROM ({sessions}))
    """


def _rating(speed: str) -> str:
    s = f"coalesce({speed}, 0)"
    return (
        f"CASE WHEN {s} > 30 THEN 'Excellent (>30)' WHEN {s} > 20 THEN 'Good (20-30)' "
        f"WHEN {s} > 15 THEN 'Average (15-20)' WHEN {s} > 10 THEN 'Below Average (10-15)' "
        f"ELSE 'Needs Optimization (<10)' END"
    )


_REQUEST_SPEEDS = _speeds(
    f"""
    SELECT r.*, t.n AS output_tokens, t.first_ts, t.last_ts, t.n_times
    FROM ({_REQUESTS}) r LEFT JOIN (
      SELECT {_REQUEST} AS request_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
             count(DISTINCT ts) AS n_times FROM events GROUP BY ALL) t USING (request_id)
    """
)


def _round(digits: int, names: tuple[str, ...]) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_SUMMARY = f"""
SELECT request_id, count(*) AS n_samples, avg(cpu) AS cpu_avg, max(cpu) AS cpu_max, min(cpu) AS cpu_min,
       avg(gpu_usage) AS gpu_usage_avg, max(gpu_usage) AS gpu_usage_max, min(gpu_usage) AS gpu_usage_min,
       avg(gpu_temp) AS gpu_temp_avg, max(gpu_temp) AS gpu_temp_max,
       avg(gpu_power) AS gpu_power_avg, max(gpu_power) AS gpu_power_max,
       CASE WHEN count(gpu_memory_allocated) > 0 THEN avg(coalesce(gpu_memory_allocated, 0)) END AS gpu_memory_avg,
       greatest(coalesce(max(system_memory), 0), 0) AS system_memory_peak,
       greatest(coalesce(max(pytorch_allocated), 0), 0) AS pytorch_memory_peak,
       greatest(coalesce(max(gpu_memory_used), 0), 0) AS gpu_memory_peak,
       max(ts) AS last_ts
FROM ({_SAMPLES}) GROUP BY request_id
"""

_SUMMARY_NAMES = (
    "cpu_avg", "cpu_max", "cpu_min", "gpu_usage_avg", "gpu_usage_max", "gpu_usage_min", "gpu_temp_avg",
    "gpu_temp_max", "gpu_power_avg", "gpu_power_max", "gpu_memory_avg", "system_memory_peak",
    "pytorch_memory_peak", "gpu_memory_peak",
)

_MEMORY = f"""
SELECT s.request_id, count(*) AS n_snapshots,
       greatest(coalesce(max(system_memory), 0), 0) AS system_memory_peak,
       greatest(coalesce(max(pytorch_allocated), 0), 0) AS pytorch_memory_peak,
       greatest(coalesce(max(gpu_memory_used), 0), 0) AS gpu_memory_peak,
       CASE WHEN count(*) > 1 THEN CASE WHEN arg_max(system_memory, ts) > arg_min(system_memory, ts)
         THEN 'increasing' ELSE 'stable' END END AS system_memory_trend,
       CASE WHEN count(*) > 1 THEN CASE WHEN arg_max(coalesce(pytorch_allocated, 0), ts) > arg_min(coalesce(pytorch_allocated, 0), ts)
         THEN 'increasing' ELSE 'stable' END END AS pytorch_memory_trend,
       CASE WHEN count(*) > 1 THEN max(system_memory) - min(system_memory) END AS system_memory_variance,
       CASE WHEN count(*) > 1 THEN max(coalesce(pytorch_allocated, 0)) - min(coalesce(pytorch_allocated, 0)) END AS pytorch_memory_variance,
       CASE WHEN count(pytorch_allocated) > 0 THEN greatest(max(pytorch_allocated), 0) - any_value(b.gpu_memory_allocated) END AS model_memory_footprint,
       any_value(b.gpu_memory_total) AS total
FROM ({_SAMPLES}) s LEFT JOIN ({_BASELINE}) b USING (request_id) GROUP BY s.request_id
"""


def _grade(x: str) -> str:
    return f"CASE WHEN {x} < 6 THEN 'good' WHEN {x} < 8 THEN 'high' WHEN {x} IS NOT NULL THEN 'very_high' END"


_GAP_US = 6 * 3600 * 1_000_000

_SESSIONS = f"""
SELECT user_id AS request_id, session, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + {_GAP_US} AS end_us,
       count(*) AS n_samples, round(avg(value), 6) AS cpu_avg, max(value) AS cpu_max, min(value) AS cpu_min,
       CASE WHEN count(*) > 1 THEN CASE WHEN arg_max({_K} / 10, ts) > arg_min({_K} / 10, ts) THEN 'increasing' ELSE 'stable' END END AS system_memory_trend,
       round(CASE WHEN count(*) > 1 THEN max({_K} / 10) - min({_K} / 10) END, 6) AS system_memory_variance,
       round(avg(value) FILTER (event_type = 'click'), 6) AS gpu_temp_avg, max({_K} / 10) AS system_memory_peak,
       round(CASE WHEN count(*) FILTER (event_type <> 'error') > 0
             THEN avg(CASE WHEN event_type <> 'error' THEN {_K} / 8 ELSE 0 END) END, 6) AS gpu_memory_avg,
       min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts) AS n_times, CAST(max({_K}) AS BIGINT) AS input_tokens,
       date_trunc('day', min(ts))::TIMESTAMP AS start_ts
FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
      FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {_GAP_US}
                      THEN 0 ELSE 1 END AS opens FROM events))
GROUP BY user_id, session
"""

_RUNS = f"""
SELECT request_id, start_us, end_us, n_samples, round(cpu_avg, 6) AS cpu_avg, cpu_max, system_memory_peak,
       round(CASE WHEN n_times > 1 THEN (n_times - 1) / ((end_us - start_us) / 1e6) END, 6) AS sample_speed
FROM (SELECT user_id AS request_id, run, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, count(*) AS n_samples,
             avg(value) AS cpu_avg, max(value) AS cpu_max, greatest(max({_K} / 10), 0) AS system_memory_peak,
             count(DISTINCT ts) AS n_times
      FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) || '/' || part AS run
            FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) <= {_GAP_US}
                                 THEN 0 ELSE 1 END AS opens
                  FROM (SELECT e.*, (SELECT count(*) FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'signup' AND r.ts <= e.ts) AS part
                        FROM events e WHERE event_type <> 'signup')))
      GROUP BY user_id, run)
"""

# The watermark after the only batch: latest time in milliseconds less the delay of 10 seconds.

_PAIRS = f"""
SELECT conv_id || '-' || turn AS pair_id, {_words('response')} AS p, {_words('prompt')} AS r
FROM ({_EXCHANGES})
"""


def _bigrams(x: str) -> str:
    return f"list_transform(range(1, len({x})), lambda i: {x}[i] || chr(31) || {x}[i + 1])"


def _f(shared: str, a: str, b: str) -> str:
    return f"CASE WHEN {shared} > 0 THEN 2.0 * {shared} / ({a} + {b}) ELSE 0.0 END::DOUBLE"


_ROUGE_N = f"""
SELECT pair_id,
       {_f('len(list_intersect(p, r))', 'len(list_distinct(p))', 'len(list_distinct(r))')} AS rouge_1,
       {_f('len(list_intersect(p2, r2))', 'len(list_distinct(p2))', 'len(list_distinct(r2))')} AS rouge_2
FROM (SELECT *, {_bigrams('p')} AS p2, {_bigrams('r')} AS r2 FROM ({_PAIRS}))
"""

_ROUGE_N_COUNTED = f"""
WITH g AS (SELECT pair_id, p, r, {_bigrams('p')} AS p2, {_bigrams('r')} AS r2 FROM ({_PAIRS})),
rows AS (
  SELECT pair_id, 1 AS n, unnest(p) AS gram, 1 AS a, 0 AS b FROM g UNION ALL
  SELECT pair_id, 1, unnest(r), 0, 1 FROM g UNION ALL
  SELECT pair_id, 2, unnest(p2), 1, 0 FROM g UNION ALL
  SELECT pair_id, 2, unnest(r2), 0, 1 FROM g),
c AS (SELECT pair_id, n, gram, sum(a) AS a, sum(b) AS b FROM rows GROUP BY ALL),
f AS (SELECT pair_id, n, CASE WHEN sum(least(a, b)) > 0 THEN 2.0 * sum(least(a, b)) / (sum(a) + sum(b)) ELSE 0.0 END::DOUBLE AS f
      FROM c GROUP BY ALL)
SELECT pair_id, round(coalesce(max(f) FILTER (n = 1), 0), 6) AS rouge_1,
       round(coalesce(max(f) FILTER (n = 2), 0), 6) AS rouge_2
FROM f GROUP BY pair_id
"""

_ROUGE_L = f"""
WITH RECURSIVE pr AS (SELECT * FROM ({_PAIRS})),
p AS (SELECT pair_id, unnest(p) AS w, generate_subscripts(p, 1) AS j FROM pr),
q AS (SELECT pair_id, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM pr),
t AS (
  SELECT pair_id, 0::BIGINT AS i, j, w, 0::BIGINT AS v FROM p
  UNION ALL
  SELECT pair_id, i, j, w, max(c) OVER (PARTITION BY pair_id ORDER BY j)
  FROM (SELECT o.pair_id, q.i::BIGINT AS i, o.j, o.w,
               greatest(o.v, CASE WHEN o.w = q.w THEN o.left_v + 1 ELSE 0 END) AS c
        FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY pair_id ORDER BY j), 0) AS left_v FROM t) o
        JOIN q ON q.pair_id = o.pair_id AND q.i = o.i + 1)
)
SELECT pr.pair_id, {_f('max(t.v)', 'any_value(len(pr.p))', 'any_value(len(pr.r))')} AS rouge_l
FROM pr JOIN t ON t.pair_id = pr.pair_id AND t.i = len(pr.r)
GROUP BY pr.pair_id
"""

_BERTSCORE = """
WITH v AS (SELECT vec_id // 32 AS pair_id, vec_id % 32 < 16 AS is_p, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT p.pair_id, p.vec_id AS a, r.vec_id AS b, list_cosine_similarity(p.e, r.e) AS c
      FROM v p JOIN v r ON p.pair_id = r.pair_id WHERE p.is_p AND NOT r.is_p),
pa AS (SELECT pair_id, avg(c) AS p FROM (SELECT pair_id, a, max(c) AS c FROM s GROUP BY ALL) GROUP BY pair_id),
ra AS (SELECT pair_id, avg(c) AS r FROM (SELECT pair_id, b, max(c) AS c FROM s GROUP BY ALL) GROUP BY pair_id),
z AS (SELECT i.pair_id, coalesce(p, 0) AS p, coalesce(r, 0) AS r
      FROM (SELECT DISTINCT pair_id FROM v) i LEFT JOIN pa USING (pair_id) LEFT JOIN ra USING (pair_id))
SELECT pair_id, p AS bertscore_precision, r AS bertscore_recall,
       CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END AS bertscore_f1
FROM z
"""

_EVAL_LOSS = f"""
SELECT round(avg(loss), 4) AS eval_loss, count(*) AS num_samples FROM (
  SELECT pair_id, avg(length(w)) AS loss FROM (
    SELECT pair_id, len(r) AS prompt_len, unnest(list_concat(r, p)) AS w,
           generate_subscripts(list_concat(r, p), 1) - 1 AS pos FROM ({_PAIRS}))
  WHERE pos >= prompt_len GROUP BY pair_id)
"""

_IDS = (
    "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS INTEGER))"
)

_ORACLE = {
    "read_jsonl": _ALPACA_PAIRS,
    "read_json": _ALPACA_PAIRS,
    "read_csv": _ALPACA_PAIRS,
    "read_tsv": _ALPACA_PAIRS,
    "read_txt": f"""
        SELECT t AS text FROM (SELECT {_strip('u')} AS t FROM (
          SELECT unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10))) AS u FROM documents))
        WHERE t <> ''""",
    "read_mixed_folder": f"""
        SELECT 'json' AS kind, 'alpaca' AS fmt, count(*) AS n FROM documents UNION ALL
        SELECT 'csv', 'alpaca', count(*) FROM documents UNION ALL
        SELECT 'txt', 'plain_text', count(*) FROM (SELECT {_strip('u')} AS t FROM (
          SELECT unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10))) AS u FROM documents))
        WHERE t <> ''""",
    "read_metric_maps": _METRICS,
    "detect_format": f"""
        SELECT doc_id, fmt, CASE fmt {_SHOWN} END AS shown
        FROM (SELECT doc_id, {_FORMAT_OF_SOURCE} AS fmt FROM documents)""",
    "detect_format_first": f"""
        SELECT source, {_FORMAT_OF_SOURCE} AS fmt, count(*) AS n FROM documents GROUP BY ALL""",
    "to_pair": f"""
        SELECT doc_id,
          CASE source WHEN 'src0' THEN lang || {_NL} || source WHEN 'src1' THEN lang WHEN 'src4' THEN '' ELSE source END AS prompt,
          CASE source WHEN 'src3' THEN lang ELSE text END AS response,
          '{SYSTEM_PROMPT}' AS system, CASE source WHEN 'src3' THEN text ELSE '' END AS cot, false AS error
        FROM documents""",
    "dialogue_expand": _EXPANDED,
    "dialogue_expand_nested": _NESTED,
    "chatml_pair": """
        SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user' AND text <> ''), '') AS prompt,
               coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND text <> ''), '') AS response
        FROM conversations GROUP BY conv_id""",
    "role_map": "SELECT conv_id, turn, role FROM conversations",
    "render_instruction": f"""
        SELECT conv_id, turn, CASE WHEN prompt <> '' THEN {_chat('prompt', 'response')} ELSE response END AS text
        FROM ({_EXCHANGES})""",
    "render_completion": f"""
        SELECT conv_id, turn, CASE WHEN prompt <> '' THEN prompt || {_NL} || response ELSE response END AS text
        FROM ({_EXCHANGES})""",
    "render_cot": f"""
        SELECT doc_id, CASE WHEN lang = 'en' AND text <> ''
          THEN {_chat('source', f"'让我们一步步思考：' || text || {_NL} || lang")} ELSE lang END AS text
        FROM documents""",
    "render_chat_template": f"""
        SELECT conv_id, turn, {_chat('prompt', 'response')} || {_NL} || '<|im_start|>assistant' || {_NL} AS text
        FROM ({_EXCHANGES})""",
    "classification_examples": f"""
        SELECT doc_id, {_chat('text', 'quality::VARCHAR')} AS text FROM documents JOIN labels USING (doc_id)""",
    "text_measures": f"""
        SELECT doc_id, length(text) AS n_chars,
               length(replace(replace(replace(text, {_NL}, ''), ' ', ''), chr(9), '')) AS n_solid,
               len({_words('text')}) AS n_words
        FROM ({_STRIPPED})""",
    "quality_rows": f"SELECT doc_id, {_reason('text')} AS reject_reason FROM ({_STRIPPED})",
    "quality_report": f"""
        SELECT coalesce({_reason('text')}, 'kept') AS reject_reason, count(*) AS n FROM ({_STRIPPED}) GROUP BY 1""",
    "dedup_prefix": f"""
        SELECT doc_id, order_key FROM (
        {_first_of_prefix(f"SELECT doc_id, text, {_key('doc_id')} AS order_key FROM ({_STRIPPED})")})""",
    "split_exact": _split(f"SELECT doc_id, {_key('doc_id')} AS order_key FROM documents", "doc_id"),
    "test_set_tail": f"""
        SELECT doc_id FROM (
          SELECT doc_id, row_number() OVER (ORDER BY {_key('doc_id')} DESC) AS place, count(*) OVER () AS n FROM documents)
        WHERE place <= greatest(1, trunc(n * 0.1::DOUBLE))""",
    "seeded_rank": f"""
        SELECT doc_id, row_number() OVER (ORDER BY {_key('doc_id')}) - 1 AS rank FROM documents""",
    "head_rows": f"SELECT doc_id, {_key('doc_id')} AS order_key FROM documents ORDER BY order_key LIMIT 20",
    "prepared_documents": _split(_CLEAN_DOCUMENTS, "doc_id, text"),
    "prepared_turns": _split(_CLEAN_TURNS, "conv_id, turn, prompt, response, text"),
    "prepared_turns_cot": _prepared_turns("response", f"({_reason('text')}) IS NULL"),
    "prepared_turns_completion": _prepared_turns(
        f"(prompt || {_NL} || response)", f"({_reason('text')}) IS NULL"
    ),
    "prepared_turns_unchecked": _prepared_turns(_chat("prompt", "response"), "text <> ''"),
    "prepared_broken_files": f"""
        SELECT false AS error, prompt, response FROM ({_ALPACA_PAIRS})
        UNION ALL SELECT true, NULL, '' FROM documents UNION ALL SELECT true, NULL, '' FROM documents""",
    "test_set_repeated": "SELECT greatest(1, trunc(count(*) * 0.1::DOUBLE))::BIGINT AS n FROM documents",
    "prepared_files": f"""
        SELECT split, count(*) AS n FROM (
          SELECT CASE WHEN row_number() OVER () <= greatest(1, trunc(count(*) OVER () * 0.05::DOUBLE))
                 THEN 'val' ELSE 'train' END AS split
          FROM (SELECT DISTINCT left(text, 200) FROM (
            SELECT {_strip(_chat('prompt', 'response'))} AS text FROM ({_ALPACA_PAIRS}))
            WHERE ({_reason('text')}) IS NULL))
        GROUP BY split""",
    "prepared_dialogue_files": f"""
        SELECT split, count(*) AS n FROM (
          SELECT CASE WHEN row_number() OVER () <= greatest(1, trunc(count(*) OVER () * 0.05::DOUBLE))
                 THEN 'val' ELSE 'train' END AS split
          FROM (SELECT DISTINCT left(prompt || {_NL} || response, 200) FROM (
            SELECT prompt, response, {_strip(_chat('prompt', 'response'))} AS text FROM ({_NESTED}) WHERE prompt IS NOT NULL)
            WHERE ({_reason('text')}) IS NULL))
        GROUP BY split""",
    "rejected_dialogue_examples": f"""
        SELECT CASE WHEN length({_strip(_chat('p', 'text'))}) BETWEEN 10 AND 1000 THEN 'kept' ELSE 'length' END AS reject_reason,
               count(*) AS n
        FROM ({_CONTEXTS}) GROUP BY 1""",
    "prepared_chat_template": f"""
        SELECT conv_id, turn, text FROM (
          SELECT conv_id, turn, {_strip(_chat('prompt', 'response') + f" || {_NL} || '<|im_start|>assistant'")} AS text
          FROM ({_EXPANDED}) WHERE prompt IS NOT NULL)
        WHERE length(text) BETWEEN 10 AND 8192""",
    "written_examples": _split(_CLEAN_DOCUMENTS, "doc_id"),
    "run_manifest": f"""
        SELECT 'instruction' AS task_type, 'plain_text' AS dataset_format,
               count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val
        FROM ({_split(_CLEAN_DOCUMENTS, 'doc_id')})""",
    "preview": f"""
        SELECT source, n, fmt, array_to_string(json_keys(json), ',') AS keys, left(json, 500) AS head
        FROM (SELECT source, {_FORMAT_OF_SOURCE} AS fmt, {_RECORD_JSON} AS json,
                     count(*) OVER (PARTITION BY source) AS n,
                     row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
        WHERE place = 1""",
    "loss_summary": f"""
        WITH t AS ({_TRAIN}),
        a AS (SELECT run_id, arg_min(value, step) AS initial_loss, arg_max(value, step) AS final_loss,
                     min(value) AS best_loss, max(step) AS total_steps, count(*) AS n_points FROM t GROUP BY run_id),
        b AS (SELECT t.run_id, min(step) AS best_step FROM t JOIN a ON t.run_id = a.run_id AND t.value = a.best_loss GROUP BY t.run_id),
        e AS (SELECT run_id, min(value) AS best_eval_loss FROM ({_METRICS}) WHERE tag = 'eval/loss' GROUP BY run_id)
        SELECT a.*, best_step, best_eval_loss,
               round(CASE WHEN initial_loss <> 0 THEN (initial_loss - final_loss) / initial_loss * 100 END, 6) AS reduction_pct
        FROM a JOIN b USING (run_id) LEFT JOIN e USING (run_id)""",
    "loss_curves": f"""
        SELECT run_id, 'train_loss' AS curve, step, value FROM ({_TRAIN}) UNION ALL
        SELECT run_id, 'eval_loss', step, value FROM ({_METRICS}) WHERE tag = 'eval/loss' UNION ALL
        SELECT run_id, 'learning_rate', step, value FROM ({_METRICS}) WHERE tag = 'train/learning_rate'""",
    "early_stop": f"""
        WITH e AS (SELECT run_id, step, value, row_number() OVER w AS place,
                     coalesce(value < min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
                   FROM ({_METRICS}) WHERE tag = 'eval/loss' WINDOW w AS (PARTITION BY run_id ORDER BY step)),
        h AS (SELECT *, place - max(CASE WHEN improved THEN place END) OVER (PARTITION BY run_id ORDER BY step) AS waited FROM e),
        s AS (SELECT run_id, min(step) FILTER (waited >= 3) AS stop_step, count(*) AS n_evals FROM h GROUP BY run_id)
        SELECT run_id, stop_step, n_evals, arg_max(step, place) AS best_step, min(value) AS best_value
        FROM h JOIN s USING (run_id) WHERE improved AND (stop_step IS NULL OR step < stop_step)
        GROUP BY run_id, stop_step, n_evals""",
    "poly_fit": f"""
        {_orthogonal_fit()}
        SELECT run_id, any_value(d)::BIGINT AS degree, any_value(n) AS n_points,
               round(CASE WHEN max(y) = min(y) THEN 0 ELSE 1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)) END, 6) AS r2
        FROM k6 GROUP BY run_id""",
    "poly_fit_curve": f"{_orthogonal_fit()} SELECT run_id, step, round(f, 4) AS fitted FROM k6",
    "poly_fit_linear": """
        SELECT user_id AS run_id, round(coalesce(regr_slope(value, event_id), 0), 6) AS slope,
               round(coalesce(regr_intercept(value, event_id), avg(value)), 4) AS intercept,
               round(CASE WHEN max(value) = min(value) THEN 0 ELSE regr_r2(value, event_id) END, 6) AS r2
        FROM events GROUP BY user_id""",
    "scoreable_pairs": """
        SELECT doc_id, source AS prompt, text AS reference FROM documents WHERE source <> '' AND text <> ''""",
    "pair_up": f"""
        SELECT conv_id || '-' || turn AS pair_id, prompt AS reference, response AS prediction FROM ({_EXCHANGES})""",
    "rouge_n": f"SELECT pair_id, round(rouge_1, 6) AS rouge_1, round(rouge_2, 6) AS rouge_2 FROM ({_ROUGE_N})",
    "rouge_n_counted": _ROUGE_N_COUNTED,
    "rouge_l": f"SELECT pair_id, round(rouge_l, 6) AS rouge_l FROM ({_ROUGE_L})",
    "rouge_corpus": f"SELECT round(avg(rouge_1), 4) AS rouge_1, round(avg(rouge_2), 4) AS rouge_2 FROM ({_ROUGE_N})",
    "word_rules": f"""
        SELECT doc_id, len({_words('text')}) AS whitespace,
               len({_words("regexp_replace(text, '([" + chr(0x4E00) + "-" + chr(0x9FFF) + chr(0x3040) + "-" + chr(0x30FF) + chr(0xAC00) + "-" + chr(0xD7A3) + "])', ' \\1 ', 'g')")}) AS cjk_char
        FROM documents""",
    "bertscore": f"""
        SELECT pair_id, {_round(5, ('bertscore_precision', 'bertscore_recall', 'bertscore_f1'))} FROM ({_BERTSCORE})""",
    "written_predictions": f"""
        SELECT conv_id || '-' || turn AS pair_id, prompt, prompt AS reference, response AS prediction FROM ({_EXCHANGES})""",
    "written_samples": f"""
        SELECT request_id, output_tokens, pytorch_memory_peak AS gpu_memory_peak
        FROM ({_REQUEST_SPEEDS}) JOIN ({_SUMMARY}) USING (request_id)""",
    "eval_loss": _EVAL_LOSS,
    "score_report": f"""
        -- two words each, in the other order: all words and half a common subsequence, no common pair
        WITH kept AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS hit, text FROM documents
                      WHERE doc_id % 4 <> 3 AND source <> ''),
        matched AS (SELECT * FROM ({_BERTSCORE}) WHERE pair_id IN (SELECT doc_id FROM kept)),
        losses AS (SELECT doc_id, avg(length(w)) AS loss FROM (
                     SELECT doc_id, unnest({_words('text')}[2:]) AS w FROM kept) GROUP BY doc_id)
        SELECT (SELECT count(*) FROM kept) AS num_samples,
               (SELECT round(avg(hit), 4) FROM kept) AS rouge_1,
               0.0::DOUBLE AS rouge_2,
               (SELECT round(avg(hit * 0.5::DOUBLE), 4) FROM kept) AS rouge_l,
               (SELECT round(avg(bertscore_precision), 4) FROM matched) AS bertscore_precision,
               (SELECT round(avg(bertscore_recall), 4) FROM matched) AS bertscore_recall,
               (SELECT round(avg(bertscore_f1), 4) FROM matched) AS bertscore_f1,
               (SELECT round(avg(loss), 4) FROM losses) AS eval_loss""",
    "held_out_report": f"""
        SELECT count(*) AS num_samples, round(avg(hit), 4) AS rouge_1, round(avg(hit), 4) AS rouge_l FROM (
          SELECT CASE WHEN turn % 4 < 2 THEN 1 ELSE 0 END AS hit
          FROM ({_split(_CLEAN_TURNS, 'conv_id, turn, prompt, response')})
          WHERE split = 'val' AND prompt <> '' AND response <> '')""",
    "token_columns": f"""
        SELECT doc_id, array_to_string({_IDS.format('text')}[1:2048], ' ') AS input_ids,
               octet_length(encode(text)) AS n_tokens, octet_length(encode(text)) > 2048 AS truncated
        FROM documents""",
    "model_token_columns": """
        SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c))[1:256], ' ') AS input_ids,
               length(text) AS n_tokens, length(text) > 256 AS truncated
        FROM conversations""",
    "masked_labels": f"""
        SELECT conv_id, turn, array_to_string(list_transform({_IDS.format('prompt || response')}[1:2048],
                 lambda x, i: CASE WHEN i <= octet_length(encode(prompt)) THEN -100 ELSE x END), ' ') AS labels
        FROM ({_EXCHANGES})""",
    "padded_batches": f"""
        SELECT doc_id, batch, max(n_real) OVER (PARTITION BY batch) AS width, n_real
        FROM (SELECT doc_id, (row_number() OVER (ORDER BY {_key('doc_id')}) - 1) // 8 AS batch,
                     least(octet_length(encode(text)), 2048) AS n_real FROM documents)""",
    "bucketed_batches": f"""
        SELECT doc_id, width, width AS n_places, n_real FROM ({_BUCKETED})""",
    "padding_by_width": f"""
        SELECT width, count(*) AS n_rows, sum(n_real)::BIGINT AS n_real,
               (count(*) * width - sum(n_real))::BIGINT AS n_padding,
               round(1 - sum(n_real) / (count(*) * width), 6) AS share
        FROM ({_BUCKETED}) GROUP BY width""",
    "speeds": f"""
        SELECT request_id, {_round(8, _SPEED_NAMES)}, input_tokens, output_tokens, total_tokens,
               {_rating('pure_generation_speed')} AS rating
        FROM ({_REQUEST_SPEEDS})""",
    "token_gaps": f"""
        SELECT request_id, us, round(gap / 1e6, 6) AS gap FROM (
          SELECT request_id, us, us - lag(us) OVER (PARTITION BY request_id ORDER BY us) AS gap
          FROM (SELECT DISTINCT {_REQUEST} AS request_id, epoch_us(ts) AS us FROM events))
        WHERE gap IS NOT NULL""",
    "resource_summary": f"""
        SELECT request_id, n_samples, {_round(8, _SUMMARY_NAMES)},
               round((epoch_us(last_ts) - epoch_us(start_ts)) / 1e6, 8) AS duration,
               round(system_memory_peak - system_memory_used, 8) AS system_memory_growth,
               round(pytorch_memory_peak - gpu_memory_allocated, 8) AS pytorch_memory_growth
        FROM ({_SUMMARY}) JOIN ({_BASELINE}) USING (request_id)""",
    "memory_analysis": f"""
        SELECT request_id, n_snapshots, system_memory_trend, pytorch_memory_trend,
               {_round(8, ('system_memory_peak', 'pytorch_memory_peak', 'gpu_memory_peak', 'system_memory_variance',
                           'pytorch_memory_variance', 'model_memory_footprint'))},
               {_grade('model_memory_footprint')} AS memory_efficiency,
               round(CASE WHEN total > 0 THEN pytorch_memory_peak / total * 100 ELSE 0 END, 8) AS memory_utilisation_pct
        FROM ({_MEMORY})""",
    "request_performance": f"""
        SELECT request_id, input_tokens, output_tokens,
               {_round(8, ('first_token_latency', 'total_inference_time', 'total_inference_speed', 'pure_generation_speed'))},
               round(pytorch_memory_peak, 8) AS gpu_memory_peak,
               {_round(8, ('gpu_usage_avg', 'gpu_temp_avg', 'gpu_power_avg'))}
        FROM ({_REQUEST_SPEEDS}) LEFT JOIN (SELECT request_id, pytorch_memory_peak, gpu_usage_avg, gpu_temp_avg, gpu_power_avg
                                            FROM ({_SUMMARY})) USING (request_id)""",
    "suggestions": f"""
        SELECT request_id, concat_ws('; ',
          CASE WHEN first_token_latency > 1.5 THEN '{ADVICE['latency']}' END,
          CASE WHEN coalesce(pure_generation_speed, 0) < 20 THEN '{ADVICE['speed']}' END,
          CASE WHEN coalesce(gpu_usage_avg, 0) < 70 THEN '{ADVICE['gpu']}' END,
          CASE WHEN coalesce(cpu_avg, 0) > 70 THEN '{ADVICE['cpu']}' END,
          CASE WHEN ({_grade('model_memory_footprint')}) = 'very_high' THEN '{ADVICE['memory']}' END,
          CASE WHEN m.pytorch_memory_peak > 7 THEN '{ADVICE['vram']}' END) AS suggestions
        FROM ({_REQUEST_SPEEDS}) s JOIN ({_SUMMARY}) r USING (request_id) JOIN ({_MEMORY}) m USING (request_id)""",
    "ratings": f"SELECT event_id, {_rating('value')} AS rating, {_grade('(value / 10)')} AS grade FROM events",
    "sessions": f"""
        SELECT request_id, start_us, end_us, n_samples, cpu_avg, cpu_max, cpu_min, gpu_temp_avg, gpu_memory_avg,
               system_memory_peak, system_memory_trend, system_memory_variance FROM ({_SESSIONS})""",
    "stream_snapshots": f"""
        SELECT request_id, window_us, us, cpu, system_memory FROM (
          SELECT user_id AS request_id, epoch_us(date_trunc('second', ts)::TIMESTAMP) AS window_us, epoch_us(ts) AS us,
                 value AS cpu, {_K} / 10 AS system_memory,
                 row_number() OVER (PARTITION BY user_id, date_trunc('second', ts) ORDER BY ts) AS place
          FROM events)
        WHERE place = 1""",
    "stream_resources": f"""
        SELECT request_id, start_us, end_us, n_samples, cpu_avg, cpu_max, cpu_min, gpu_temp_avg, gpu_memory_avg,
               system_memory_peak, system_memory_trend, system_memory_variance
        FROM ({_SESSIONS})""",
    "stream_requests": f"""
        SELECT request_id, {_round(8, _SPEED_NAMES)}, input_tokens, output_tokens, total_tokens,
               {_rating('pure_generation_speed')} AS rating
        FROM ({_speeds(f"SELECT request_id, start_ts, last_ts AS end_ts, first_ts, last_ts, n_times, n_samples AS output_tokens, input_tokens FROM ({_SESSIONS})")})""",
    "stream_examples": f"SELECT doc_id, text FROM ({_STRIPPED}) WHERE ({_reason('text')}) IS NULL",
    "reset_runs": _RUNS,
    "stream_reset_runs": _RUNS,
    "stream_dedup_first": f"""
        SELECT event_id, order_key, text FROM (
          SELECT event_id, {_key('event_id')} AS order_key, event_type || ' ' || props AS text,
                 row_number() OVER (PARTITION BY left(event_type || ' ' || props, 200) ORDER BY {_key('event_id')}) AS place FROM events)
        WHERE place = 1""",
    "stream_dedup": "SELECT DISTINCT event_type || ' ' || props AS text FROM events",
}


def oracle_sql() -> dict[str, str]:
    """Query name → SQL."""
    return dict(_ORACLE)

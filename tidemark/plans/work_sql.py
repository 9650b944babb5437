"""SQL of the relations of work in progress."""

from __future__ import annotations

_EVENTS = """
WITH e AS (SELECT user_id AS id, ts, event_id AS seq, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
ev AS (SELECT id, ts, seq, CASE k % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'resolving' WHEN 2 THEN 'graphed' WHEN 3 THEN 'failed' ELSE 'reset_quota' END AS event,
  CASE WHEN k % 5 = 3 THEN CASE WHEN k % 2 = 0 THEN 'HTTP 403 quotaExceeded' ELSE 'timeout' END END AS last_error,
  CASE WHEN k % 5 = 1 AND k % 3 = 0 THEN 'b' || k END AS bundle_id FROM e)"""

_QUEUE = """
WITH videos AS (SELECT p_partkey AS video_id, p_brand AS channel_id, TIMESTAMP '2020-01-01' + to_days(CAST(p_partkey % 900 AS INT)) AS published_at,
  CASE WHEN p_partkey % 11 = 0 THEN 93600 WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_size % 9) * 60 + p_partkey % 60 END AS seconds FROM part),
queue AS (SELECT p_partkey AS video_id, p_partkey + 1000 AS id, 'u/' || p_partkey AS url, ['queued', 'resolving', 'graphed', 'failed'][p_size % 4 + 1] AS status,
  CASE WHEN p_size % 4 = 3 THEN 'timeout' END AS last_error, TIMESTAMP '2023-01-01' AS updated_at FROM part WHERE p_partkey % 4 <> 0),
chosen AS (SELECT video_id, id AS queue_id, status, coalesce(seconds < 180, false) AS is_short,
  CASE WHEN seconds < 180 THEN 'skip' WHEN id IS NULL THEN 'insert' ELSE 'update' END AS action
  FROM videos LEFT JOIN queue USING (video_id) WHERE channel_id = 'Brand#7' AND published_at >= TIMESTAMP '2020-06-01')"""


def _after(condition: str) -> str:
    return _QUEUE + f""", again AS (SELECT * FROM chosen WHERE action <> 'skip')
SELECT video_id, q.id, q.url, CASE WHEN a.video_id IS NOT NULL AND {condition} THEN 'queued' ELSE q.status END AS status,
  CASE WHEN a.video_id IS NOT NULL AND {condition} THEN NULL ELSE q.last_error END AS last_error,
  CASE WHEN a.video_id IS NOT NULL AND {condition} THEN TIMESTAMP '2024-02-15' ELSE q.updated_at END AS updated_at
FROM queue q LEFT JOIN again a USING (video_id)
UNION ALL SELECT video_id, NULL, 'https://www.youtube.com/watch?v=' || video_id, 'queued', NULL, TIMESTAMP '2024-02-15' FROM again WHERE action = 'insert'"""


def sql() -> dict[str, str]:
    return {
        "queue_replayed": _EVENTS + """,
last AS (SELECT * FROM ev WHERE event <> 'reset_quota' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1),
again AS (SELECT l.id, min(r.ts) AS reset_at FROM last l JOIN ev r ON r.id = l.id AND r.event = 'reset_quota' AND (r.ts > l.ts OR r.ts = l.ts AND r.seq > l.seq)
  WHERE l.event = 'failed' AND l.last_error LIKE '%quotaExceeded%' GROUP BY 1)
SELECT id, CASE WHEN reset_at IS NOT NULL OR event = 'resolving' AND bundle_id IS NULL AND ts + INTERVAL 60 MINUTE <= TIMESTAMP '2024-02-15' THEN 'queued' ELSE event END AS status,
  CASE WHEN reset_at IS NULL THEN last_error END AS last_error, bundle_id,
  CASE WHEN reset_at IS NOT NULL THEN reset_at WHEN event = 'resolving' AND bundle_id IS NULL AND ts + INTERVAL 60 MINUTE <= TIMESTAMP '2024-02-15' THEN ts + INTERVAL 60 MINUTE ELSE ts END AS updated_at
FROM last LEFT JOIN again USING (id)""",
        "queue_transitions": _EVENTS + """
SELECT before, after, count(*) AS n FROM (SELECT lag(event) OVER (PARTITION BY id ORDER BY ts, seq) AS before, event AS after FROM ev WHERE event <> 'reset_quota') GROUP BY ALL""",
        "requeue_candidates": _QUEUE + " SELECT * FROM chosen",
        "requeue_counts": _QUEUE + " SELECT action, coalesce(status, 'missing_queue_row') AS status, count(*) AS n FROM chosen GROUP BY ALL",
        "queue_after_requeue": _after("true"),
        "queue_after_requeue_of_failed": _after("q.status IN ('failed', 'graphed')"),
        "remaining_units_stored": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0)",
        "benchmark_phrases": "SELECT DISTINCT doc_id, substr(b.text, 1, 30) AS word FROM documents d JOIN benchmark b ON contains(d.text, substr(b.text, 1, 30)) WHERE b.text <> ''",
        "best_titles": """
WITH n AS (SELECT DISTINCT p_name || ' - ' || p_brand AS name FROM part),
e AS (SELECT p_type || ' ' || p_name AS title, max(p_size) > 48 AS verified, min(p_size) - 2 AS subscribers, CAST(min(p_partkey) % 17 AS INT) AS rank FROM part GROUP BY 1),
a AS (SELECT *, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS a FROM n),
b AS (SELECT *, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS b FROM e),
s AS (SELECT name, title, rank, round(CASE WHEN a = b AND a <> '' THEN 100 ELSE 0 END + CASE WHEN a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) THEN 45 ELSE 0 END
  + 40 * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / len(list_distinct(string_split(a, ' ')))
  + CASE WHEN verified THEN 15 ELSE 0 END + CASE WHEN subscribers > 0 THEN 5 ELSE 0 END - rank, 6) AS score FROM a, b)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, rank, title) = 1""",
    }

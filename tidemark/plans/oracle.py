"""SQL of each relation over the stored tables, written apart from the DataFrame code."""

from __future__ import annotations

_VIEWS = """
all_comments AS (
  SELECT l_orderkey AS thread_id, l_linenumber AS line, l_partkey AS video_id, o_custkey AS actor_id, l_suppkey AS supplier_id,
         l_linenumber = 1 AS is_top_level, CAST(trunc(l_quantity) AS BIGINT) AS like_count, l_shipdate AS ts,
         CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END AS label,
         l_discount * 5 AS score_neg, l_tax * 5 AS score_pos, 1 - l_discount * 5 AS score_neu, CASE WHEN l_linenumber <> 5 THEN l_linenumber / 8 END AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
comments AS (SELECT * FROM all_comments WHERE is_top_level),
videos AS (
  SELECT p_partkey AS video_id, p_name AS title, p_type AS theme, p_brand AS label, CAST(floor(p_retailprice * 10) AS BIGINT) AS view_count, published_at
  FROM part JOIN (SELECT l_partkey, min(l_shipdate) AS published_at FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
actors AS (SELECT c_custkey AS actor_id, c_name AS name, c_mktsegment AS community FROM customer),
actor_videos AS (SELECT DISTINCT actor_id, video_id FROM all_comments),
in_community AS (SELECT c.*, community FROM all_comments c JOIN actors USING (actor_id))
"""

_MEANS = ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("score_neg", "score_neu", "score_pos", "confidence"))
_BLOCK = f"""
  count(*) AS n, count(*) FILTER (label = 'negative') AS n_negative, count(*) FILTER (label = 'neutral') AS n_neutral, count(*) FILTER (label = 'positive') AS n_positive,
  count(*) FILTER (NOT is_top_level) AS n_replies, CAST(sum(like_count + 1) AS BIGINT) AS weight,
  CAST(coalesce(sum(like_count + 1) FILTER (label = 'negative'), 0) AS BIGINT) AS negative_weight, CAST(coalesce(sum(like_count + 1) FILTER (label = 'positive'), 0) AS BIGINT) AS positive_weight,
  round(count(*) FILTER (label = 'negative') / count(*), 6) AS negative_rate, round(count(*) FILTER (label = 'neutral') / count(*), 6) AS neutral_rate,
  round(count(*) FILTER (label = 'positive') / count(*), 6) AS positive_rate,
  round(coalesce(sum(like_count + 1) FILTER (label = 'negative'), 0) / sum(like_count + 1), 6) AS weighted_negative_rate,
  round(coalesce(sum(like_count + 1) FILTER (label = 'positive'), 0) / sum(like_count + 1), 6) AS weighted_positive_rate, {_MEANS},
  round(count(*) FILTER (NOT is_top_level) / count(*), 6) AS reply_share,
  round((count(*) FILTER (label = 'positive') - count(*) FILTER (label = 'negative')) / count(*), 6) AS net_rate, round(avg(like_count), 6) AS mean_likes
"""


def _edges(least: int) -> str:
    return f"""
kept AS (SELECT * FROM actor_videos WHERE actor_id IN (SELECT actor_id FROM actor_videos GROUP BY 1 HAVING count(*) >= 2)),
edges AS (SELECT x.actor_id AS a, y.actor_id AS b, count(*) AS weight FROM kept x JOIN kept y ON x.video_id = y.video_id AND x.actor_id < y.actor_id GROUP BY 1, 2 HAVING count(*) >= {least}),
ends AS (SELECT a AS u, b AS v, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
deg AS (SELECT u AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM ends GROUP BY 1)
"""



def _threads(source: str = "all_comments", *by: str, name: str = "threads") -> str:
    """CTEs of the threads (of each `by`) of a source of comments; the last is called `name`."""
    keys = "".join(f"{k}, " for k in by)
    count = ", ".join(str(i + 1) for i in range(len(by) + 1))
    return f"""
{name}0 AS (
  SELECT {keys}thread_id, min(video_id) AS video_id, count(*) AS n, count(*) FILTER (NOT is_top_level) AS n_replies, count(DISTINCT actor_id) AS n_actors,
  count(DISTINCT actor_id) FILTER (NOT is_top_level) AS n_reply_actors,
         CAST(sum(like_count) AS BIGINT) AS likes, CAST(sum(like_count + 1) AS BIGINT) AS weight,
         CAST(coalesce(sum(like_count + 1) FILTER (NOT is_top_level), 0) AS BIGINT) AS reply_weight, min(ts) AS first_at, max(ts) AS last_at,
         count(*) FILTER (label = 'positive') AS n_pos, count(*) FILTER (label = 'negative') AS n_neg,
         count(*) FILTER (NOT is_top_level AND label = 'positive') AS r_pos, count(*) FILTER (NOT is_top_level AND label = 'negative') AS r_neg,
         coalesce(sum(like_count + 1) FILTER (label = 'positive'), 0) AS w_pos, coalesce(sum(like_count + 1) FILTER (label = 'negative'), 0) AS w_neg,
         min({{ts: ts, line: line, label: label}}) FILTER (is_top_level) AS parent
  FROM {source} GROUP BY {count}),
{name}1 AS (SELECT *, parent.label AS parent_label, n_pos / n AS pos, n_neg / n AS neg, CASE WHEN n_replies > 0 THEN r_pos / n_replies ELSE 0 END AS rpos, CASE
  WHEN n_replies > 0 THEN r_neg / n_replies ELSE 0 END AS rneg FROM {name}0),
{name}2 AS (
  SELECT *, 4 * pos * neg AS tb, 4 * rpos * rneg AS rb, 4 * (w_pos / weight) * (w_neg / weight) AS wb,
    n_replies > 0 AND ((pos >= 0.15 AND neg >= 0.15) OR (rpos >= 0.15 AND rneg >= 0.15)) AS conflict_thread,
    n_replies >= 2 AND r_pos >= 1 AND r_neg >= 1 AS strict_reply_conflict, n_replies >= 3 AND rneg >= 0.6 AND rpos < 0.15 AS pile_on,
    coalesce(parent_label = 'positive', false) AND rneg >= 0.25 OR coalesce(parent_label = 'negative', false) AND rpos >= 0.25 OR coalesce(parent_label = 'neutral',
    false) AND rpos >= 0.15 AND rneg >= 0.15 AS parent_opposition,
    n_replies > 0 AND neg >= 0.5 AND pos < 0.1 AS negative_consensus, n_replies > 0 AND pos >= 0.5 AND neg < 0.1 AS positive_consensus
  FROM {name}1),
{name} AS (
  SELECT *, CASE WHEN conflict_thread THEN greatest(tb, rb) ELSE 0 END AS intensity, CASE WHEN conflict_thread THEN n_replies ELSE 0 END AS conflict_replies, CASE
  WHEN conflict_thread THEN reply_weight ELSE 0 END AS conflict_reply_weight FROM {name}2)
"""


_THREADS = _threads()


def _conflict(key: str) -> str:
    replied = "CASE WHEN count(*) FILTER (n_replies > 0) > 0 THEN {} / count(*) FILTER (n_replies > 0) ELSE 0 END"
    clash, against = "count(*) FILTER (conflict_thread)", "count(*) FILTER (parent_opposition)"
    over = lambda a, b: f"CASE WHEN sum({b}) <> 0 THEN sum({a}) / sum({b}) ELSE 0 END"
    share, heavy = over("conflict_replies", "n_replies"), over("conflict_reply_weight", "reply_weight")
    return f"""
SELECT {key}, count(*) AS n_threads, count(*) FILTER (n_replies > 0) AS n_replied, CAST(sum(n_replies) AS BIGINT) AS n_replies, {clash} AS n_conflict,
  count(*) FILTER (strict_reply_conflict) AS n_strict, count(*) FILTER (pile_on) AS n_pile_on, {against} AS n_opposition,
  round(max(tb), 6) AS max_bipolarity, round(avg(tb), 6) AS mean_bipolarity, round(max(rb), 6) AS max_reply_bipolarity, round(coalesce(avg(rb) FILTER (n_replies > 0), 0), 6) AS mean_reply_bipolarity,
  round({clash} / count(*), 6) AS conflict_rate, round({replied.format(clash)}, 6) AS conflict_rate_replied, round(sum(intensity), 6) AS intensity,
  CAST(sum(conflict_replies) AS BIGINT) AS conflict_replies, round({share}, 6) AS conflict_reply_share, CAST(sum(conflict_reply_weight) AS BIGINT) AS conflict_reply_weight,
  round({heavy}, 6) AS weighted_conflict_share,
  round({over('intensity * n_replies', 'n_replies')}, 6) AS reply_intensity, round({over('intensity * reply_weight', 'reply_weight')}, 6) AS weighted_intensity,
  round({clash} * {replied.format(clash)}, 6) AS conflict_score, round({clash} * {share}, 6) AS reply_conflict_score, round({clash} * {heavy}, 6) AS weighted_conflict_score,
  round({against} * {replied.format(clash)}, 6) AS opposition_score
FROM {{source}} GROUP BY ALL"""


_EVENTS = """
happenings(event_id, s) AS (VALUES (0, DATE '1996-07-01'), (1, DATE '1997-10-01'), (2, DATE '1999-01-01'), (3, DATE '2000-04-01'), (4, DATE '2001-07-01'))
"""

_ASPECTS = """
units AS (
  SELECT concat_ws('-', thread_id, line, actor_id, video_id, ts) AS unit_id, ts, like_count, line, c.label, theme, video_id, actor_id, CASE
  WHEN supplier_id % 2 = 0 THEN 'forum_a' ELSE 'forum_b' END AS platform,
         CASE WHEN month(ts) <= 6 THEN 'first' WHEN month(ts) = 12 THEN 'unclear' ELSE 'second' END AS half
  FROM all_comments c JOIN videos USING (video_id)),
aspect_rows AS (
  SELECT unit_id, ts, like_count, platform, video_id, theme AS aspect, CASE WHEN line = 7 THEN 'mixed' ELSE label END AS sentiment, CAST(line % 4 AS DOUBLE) AS severity FROM units
  UNION ALL SELECT unit_id, ts, like_count, platform, video_id, half, 'unclear', 0 FROM units),
judged AS (SELECT u.*, CASE WHEN month(ts) % 5 <> 0 THEN theme ELSE 'other' END AS aspect FROM units u)
"""




_VIDEO_EDGES = """
busy AS (SELECT * FROM actor_videos WHERE video_id IN (SELECT video_id FROM actor_videos GROUP BY 1 HAVING count(*) >= 10)),
edges AS (SELECT x.video_id AS a, y.video_id AS b, count(*) AS weight FROM busy x JOIN busy y ON x.actor_id = y.actor_id AND x.video_id < y.video_id GROUP BY 1, 2 HAVING count(*) >= 5),
ends AS (SELECT a AS u, b AS v, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
deg AS (SELECT u AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM ends GROUP BY 1)
"""


_QUEUE = """
WITH q AS (SELECT o_custkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 'graphed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, CASE
  WHEN o_orderstatus = 'P' THEN 'Quota ' || o_orderpriority END AS last_error, o_orderdate AS updated_at FROM orders)
"""


def _continuity(n: int) -> str:
    return f"""
blocks{n} AS (SELECT video_id, ntile({n}) OVER (ORDER BY published_at, video_id) - 1 AS block FROM videos),
seen{n} AS (SELECT DISTINCT actor_id, block FROM actor_videos JOIN blocks{n} USING (video_id)),
cont{n} AS (
  SELECT {n} AS n_windows, x.block, count(*) AS n_base, count(y.actor_id) AS n_returned FROM seen{n} x LEFT JOIN seen{n} y ON y.actor_id = x.actor_id AND y.block = x.block + 1
  WHERE x.block < {n - 1} GROUP BY 1, 2)"""


def _with(*parts: str, body: str) -> str:
    return "WITH " + ",".join((_VIEWS, *parts)) + body


def _lexicon(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


def _theme_rules() -> str:
    from tidemark.operators.themes import THEME_RULES

    hits = ", ".join("{n: " + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words) + f", o: {-i}, name: '{name}'}}" for i,
        (name, words) in enumerate(THEME_RULES))
    return f"""
WITH d AS (SELECT lower(coalesce(text, '')) AS t FROM documents), f AS (SELECT list_filter([{hits}], lambda x: x.n > 0) AS f FROM d)
SELECT coalesce(list_reverse_sort(f)[1].name, 'other') AS primary_theme, CASE WHEN len(f) > 0 THEN array_to_string(list_transform(f,
  lambda x: x.name), ';') ELSE 'other' END AS theme_labels, count(*) AS n FROM f GROUP BY 1, 2"""


def _aspect_summary() -> str:
    def side(name: str, x: str) -> str:
        label = f"'{name}'"
        return f"""round(n_{name} / n_units, 6) AS {name}_rate, round((n_{name} / n_units) / nullif((SELECT avg(CASE WHEN label = {label} THEN 1.0 ELSE 0 END)
        FROM units), 0), 6) AS {name}_lift, round(n_{name} / {x}_units, 6) AS {name}_share, round(w_{x} / w, 6) AS weighted_{name}_rate,
  round(n_{name} / full_n, 6) AS {name}_prevalence, round((n_{name} / full_n) / nullif(full_{x}, 0), 6) AS {name}_prevalence_lift"""

    return f"""
, f AS (SELECT *, sentiment IN ('negative', 'mixed') AS neg, sentiment IN ('positive', 'mixed') AS pos, like_count + 1 AS heavy FROM aspect_rows),
t AS (SELECT count(DISTINCT unit_id) AS all_units, greatest(count(DISTINCT unit_id) FILTER (neg), 1) AS neg_units, greatest(count(DISTINCT unit_id) FILTER (pos), 1) AS pos_units FROM f),
e AS (SELECT count(*) AS full_n, avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0 END) AS full_neg, avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0 END) AS full_pos FROM all_comments),
a AS (SELECT aspect, count(DISTINCT unit_id) AS n_units, count(DISTINCT unit_id) FILTER (neg) AS n_negative, count(DISTINCT unit_id) FILTER (pos) AS n_positive, sum(heavy) AS w,
  coalesce(sum(heavy) FILTER (neg), 0) AS w_neg, coalesce(sum(heavy) FILTER (pos), 0) AS w_pos, avg(severity) AS sev FROM f WHERE aspect <> 'unclear' GROUP BY 1)
SELECT aspect, n_units, n_negative, n_positive, round(n_units / all_units, 6) AS mention_rate, round(sev, 6) AS mean_severity, {side('negative', 'neg')}, {side('positive', 'pos')} FROM a, t, e"""


def _aspect_daily(platform: str) -> str:
    return f"SELECT {platform}CAST(ts AS DATE) AS day, aspect, count(DISTINCT unit_id) AS n_units, count(*) FILTER (sentiment IN ('negative', 'mixed')) AS n_negative, count(*) FILTER (sentiment IN ('positive', 'mixed')) AS n_positive, round(avg(severity), 6) AS mean_severity, CAST(sum(like_count + 1) AS BIGINT) AS weight FROM aspect_rows WHERE aspect <> 'unclear' GROUP BY ALL"


def _shares(rows: str, key: str) -> str:
    return f" SELECT {key}, aspect, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY {key}) AS BIGINT) AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY {key}), 6) AS share FROM {rows} GROUP BY 1, 2"


def _scored_units() -> str:
    from tidemark.operators.aspects import ASPECT_KEYWORDS

    tests = ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{aspect}' END" for aspect, words in ASPECT_KEYWORDS.items())
    return f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label FROM documents LEFT
  JOIN labels USING (doc_id)),
h AS (SELECT doc_id, label, concat_ws(';', {tests}) AS aspect_keyword_hits FROM d)
SELECT * FROM h WHERE label = 'negative' OR aspect_keyword_hits <> ''"""


def _external_units() -> str:
    return """
SELECT CAST(event_id AS VARCHAR) AS unit_id, 'external_post' AS source_type, CASE WHEN user_id % 2 = 0 THEN 'forum_a' ELSE 'forum_b' END AS source,
  CAST(NULL AS BIGINT) AS video_id, ts, value AS like_count, '' AS label, event_type || ' ' || event_id AS text FROM events"""


def _prefixed(table: str, prefix: str) -> str:
    import re

    return ", ".join(f"{table}.{c} AS {prefix}_{c}" for c in re.findall(r" AS (\w+)(?=,|\s*$|\n)", _BLOCK))


def _label_videos() -> str:
    """Every video's themes: model labels where there are any, else words of title and theme."""
    from tidemark.operators.themes import THEME_RULES

    names = [name for name, _ in THEME_RULES]
    known = ", ".join(f"'{n}'" for n in names)
    listed = ", ".join(f"'{n}'" for n in (*names[:6], "no_such_theme", " food_culture "))
    hits = ", ".join("{n: " + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words) + f", o: {-i}, name: '{name}'}}" for i,
        (name, words) in enumerate(THEME_RULES))
    at = lambda n: f"[{listed}][({n}) % 8 + 1]"
    k = "p_partkey"
    return f"""
, raw AS (
  SELECT {k} AS video_id, 1 AS seq, {at(k)} AS p, [{at(k)}, {at(k + ' + 1')}, {at(k)}] AS l, 'talk' AS format FROM part WHERE {k} % 3 <> 0
  UNION ALL SELECT {k}, 2, {at(k + ' + 3')}, [{at(k + ' + 6')}], 'vlog' FROM part WHERE {k} % 5 = 0),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq DESC) AS i FROM raw) WHERE i = 1 AND video_id IN (SELECT video_id FROM videos)),
kept AS (SELECT *, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x IN ({known})) AS good FROM latest),
uniq AS (SELECT *, list_filter(good, lambda x, i: list_position(good, x) = i) AS u FROM kept),
model AS (SELECT video_id, CASE WHEN trim(p) IN ({known}) THEN trim(p) ELSE 'other' END AS primary_theme, CASE
  WHEN len(u) > 0 THEN array_to_string(u, ';') ELSE 'other' END AS theme_labels, 'model' AS theme_source, format FROM uniq),
words AS (SELECT video_id, list_filter([{hits}], lambda x: x.n > 0) AS f FROM (SELECT video_id, lower(concat_ws(' ', title, theme)) AS t FROM videos)
  WHERE video_id NOT IN (SELECT video_id FROM model)),
themed AS (
  SELECT * FROM model UNION ALL
  SELECT video_id, coalesce(list_reverse_sort(f)[1].name, 'other'), CASE WHEN len(f) > 0 THEN array_to_string(list_transform(f,
  lambda x: x.name), ';') ELSE 'other' END, 'keyword', 'unclear' FROM words),
labelled AS (SELECT *, '' AS secondary_themes, 'unknown' AS setting, 'unknown' AS audience_intent, '' AS entities, '' AS theme_reason,
  CAST(len(string_split(theme_labels, ';')) AS INT) AS n_theme_labels FROM themed)"""


def _duration(s: str) -> str:
    minutes = f"CAST(round({s} / 60) AS BIGINT)"
    return f"CASE WHEN {s} < 60 THEN printf('%.0fs', {s}) WHEN {s} < 5400 THEN printf('%dm', {minutes}) ELSE printf('%dh %02dm', {minutes} // 60, {minutes} % 60) END"


def _metrics() -> str:
    from tidemark.plans import channels_sql as c

    found = _threads("cc", "channel", name="cthreads")
    by_video = _conflict("channel, video_id").format(source="cthreads")
    by_theme = _conflict("channel, theme").format(source="(SELECT t.*, theme FROM cthreads t JOIN videos USING (video_id))")
    return c.metrics(found, by_video, by_theme) + "," + c.RANKS + "," + c.INDICES


def _diagnostics(found: dict[str, str]) -> str:
    """Ten findings over the SQL of the tables that they are drawn from."""
    tables = ("channel_overview", "commenter_tiers", "continuity_sensitivity", "rolling_retention", "network_summary", "community_summary",
        "community_theme_affinity", "video_network_summary", "video_cluster_summary", "video_cluster_theme_affinity")
    held = ", ".join(f"{t}_ AS ({found[t]})" for t in tables)
    top = lambda t, name, size: f"(SELECT {name} AS subject, lift FROM {t}_ WHERE {size} >= (SELECT max({size}) FROM {t}_) / 4 AND lift >= 1.2 ORDER BY lift DESC, {size} DESC, {name} LIMIT 1)"
    return f"""
WITH {held},
f(area, metric, subject, value, most, reading) AS (
  SELECT 'audience_mix', 'low_tier_share', NULL, pct_commenters, NULL, CASE WHEN pct_commenters >= 80 THEN 'casual_heavy' ELSE 'repeat_base' END FROM commenter_tiers_ WHERE tier = 'one_time'
  UNION ALL SELECT 'audience_mix', 'high_tier_commenters', NULL, n_commenters, NULL, 'measurable_core' FROM commenter_tiers_ WHERE tier = 'core'
  UNION ALL SELECT 'retention', 'window_sensitivity_return_range', NULL, min(weighted_return_rate), max(weighted_return_rate),
    CASE WHEN round(max(weighted_return_rate) - min(weighted_return_rate), 6) <= 0.08 THEN 'stable' ELSE 'depends_on_windows' END FROM continuity_sensitivity_ HAVING count(weighted_return_rate) > 0
  UNION ALL SELECT 'retention', 'rolling_return_range', NULL, min(return_rate), max(return_rate), 'over_time' FROM rolling_retention_ HAVING count(return_rate) > 0
  UNION ALL SELECT 'audience_structure', 'audience_communities', NULL, n_communities, (SELECT pct_nodes FROM community_summary_ ORDER BY n_nodes DESC LIMIT 1), 'largest_share' FROM network_summary_
  UNION ALL SELECT 'audience_structure', 'community_concentration_hhi', NULL, hhi, effective_communities, 'effective_communities' FROM network_summary_
  UNION ALL SELECT 'audience_structure', 'max_k_core', NULL, max_core, NULL, 'embeddedness' FROM network_summary_
  UNION ALL SELECT 'audience_structure', 'top_audience_affinity', subject, lift, NULL, 'over_indexes' FROM {top("community_theme_affinity", "community || ':' || theme", "group_pairs")}
  UNION ALL SELECT 'content_portfolio', 'video_shared_audience_clusters', NULL, n_communities, round(100 * ((SELECT max(n_videos) FROM video_cluster_summary_) / (SELECT n_videos FROM channel_overview_)), 6),
    'largest_share' FROM video_network_summary_
  UNION ALL SELECT 'content_portfolio', 'top_video_cluster_affinity', subject, lift, NULL, 'over_indexes' FROM {top("video_cluster_theme_affinity", "cluster || ':' || label", "cluster_videos")})
SELECT area, metric, subject, CAST(value AS DOUBLE) AS value, CAST(most AS DOUBLE) AS most, reading FROM f WHERE value IS NOT NULL"""


def oracle() -> dict[str, str]:
    from tidemark.operators.sentiment import EVENT_NEGATIVE_WORDS, EVENT_POSITIVE_WORDS, NEGATIVE_WORDS
    from tidemark.plans import channels_sql, graph_sql, labels_sql, outside_sql, work_sql

    found = work_sql.sql() | labels_sql.sql(_VIEWS) | outside_sql.sql(_VIEWS, _THREADS) | graph_sql.sql(_VIEWS, _edges(3), _VIDEO_EDGES) | {
        "video_metrics": _with(body="""
SELECT v.video_id, title, theme, published_at, strftime(published_at, '%Y-%m') AS month, view_count, coalesce(n, 0) AS n_comments, coalesce(a, 0) AS n_commenters,
  coalesce(l, 0) AS likes, last AS last_comment_at
FROM videos v LEFT JOIN (SELECT video_id, count(*) AS n, count(DISTINCT actor_id) AS a, CAST(sum(like_count) AS BIGINT) AS l, max(ts) AS last FROM comments GROUP BY 1) c USING (video_id)"""),
        "channel_overview": _with(body="""
SELECT * FROM (SELECT count(*) AS n_videos, min(published_at) AS first_video_at, max(published_at) AS last_video_at, CAST(coalesce(sum(view_count), 0) AS BIGINT) AS views FROM videos),
  (SELECT count(*) AS n_comments, count(DISTINCT actor_id) AS n_commenters, CAST(coalesce(sum(like_count), 0) AS BIGINT) AS likes FROM comments)"""),
        "commenter_activity": _with(body="""
SELECT c.*, name FROM (SELECT actor_id, count(*) AS n_comments, count(DISTINCT video_id) AS n_videos, CAST(sum(like_count) AS BIGINT) AS likes, min(ts) AS first_at,
  max(ts) AS last_at FROM comments GROUP BY 1) c LEFT JOIN actors USING (actor_id)"""),
        "commenter_tiers": _with(body="""
, act AS (SELECT actor_id, count(*) AS nc, count(DISTINCT video_id) AS nv, sum(like_count) AS l FROM all_comments GROUP BY 1),
t AS (SELECT *, nv / (SELECT count(*) FROM videos) AS cov FROM act),
u AS (SELECT *, CASE WHEN nv <= 1 THEN 'one_time' WHEN cov >= 0.01 AND nv >= 3 THEN 'core' WHEN cov >= 0.005 THEN 'regular' ELSE 'returning' END AS tier FROM t)
SELECT tier, count(*) AS n_commenters, round(avg(nc), 6) AS mean_comments, CAST(median(nv) AS DOUBLE) AS median_videos, CAST(sum(nc) AS BIGINT) AS comments,
  CAST(sum(l) AS BIGINT) AS likes, round(100 * (count(*) / sum(count(*)) OVER ()), 6) AS pct_commenters FROM u GROUP BY 1"""),
        "continuity_w4": _with(_continuity(4), body=" SELECT *, round(n_returned / n_base, 6) AS return_rate FROM cont4"),
        "continuity_sensitivity": _with(*map(_continuity, (3, 4, 6, 8)), body="""
, every AS (SELECT * FROM cont3 UNION ALL SELECT * FROM cont4 UNION ALL SELECT * FROM cont6 UNION ALL SELECT * FROM cont8)
SELECT n_windows, count(*) AS n_transitions, CAST(sum(n_base) AS BIGINT) AS n_base, round(sum(n_returned) / sum(n_base), 6) AS weighted_return_rate,
  round(quantile_cont(n_returned / n_base, 0.5), 6) AS median_return_rate, round(min(n_returned / n_base), 6) AS least_return_rate,
  round(max(n_returned / n_base), 6) AS most_return_rate FROM every GROUP BY 1"""),
        "rolling_retention": _with(body="""
, placed AS (SELECT video_id, row_number() OVER (ORDER BY published_at, video_id) - 1 AS i, count(*) OVER () AS n FROM videos),
cutoffs AS (SELECT unnest(generate_series(0, (SELECT max(n) FROM placed) - 100, 25)) AS cutoff),
held AS (SELECT cutoff, actor_id, bool_or(i < cutoff + 50) AS base, bool_or(i >= cutoff + 50) AS future FROM cutoffs JOIN placed ON i >= cutoff AND i < cutoff + 100
  JOIN actor_videos USING (video_id) GROUP BY 1, 2)
SELECT CAST(cutoff AS INT) AS cutoff, count(*) FILTER (base) AS n_base, count(*) FILTER (future) AS n_future, count(*) FILTER (base AND future) AS n_returned,
  round(count(*) FILTER (base AND future) / nullif(count(*) FILTER (base), 0), 6) AS return_rate FROM held GROUP BY 1"""),
        "sentiment_summary": _with(body=f"""
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(like_count + 1) / sum(sum(like_count + 1)) OVER (), 6) AS weight_share,
  count(*) FILTER (NOT is_top_level) AS n_replies, round(count(*) FILTER (NOT is_top_level) / count(*), 6) AS reply_share, {_MEANS} FROM all_comments GROUP BY 1"""),
        "reply_sentiment": _with(body=f" SELECT CASE WHEN is_top_level THEN 'top_level' ELSE 'reply' END AS is_top_level_label, {_BLOCK} FROM all_comments GROUP BY 1"),
        "thread_sentiment": _with(body=f"""
, a AS (SELECT thread_id, {_BLOCK} FROM all_comments GROUP BY 1), r AS (SELECT thread_id, {_BLOCK} FROM all_comments WHERE NOT is_top_level GROUP BY 1)
SELECT a.thread_id, {_prefixed('a', 'all')}, {_prefixed('r', 'reply')} FROM a LEFT JOIN r USING (thread_id)"""),
        "video_cluster_sentiment": _with(body=f" SELECT video_cluster, {_BLOCK}, count(DISTINCT actor_id) AS n_actors, count(DISTINCT video_id) AS n_videos FROM (SELECT c.*, v.label AS video_cluster FROM all_comments c JOIN videos v USING (video_id)) GROUP BY 1"),
        "document_sentiment": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label, toxic * 0.9::DOUBLE AS score_neg, 'model' AS sentiment_source FROM documents JOIN labels USING (doc_id)",
        "document_sentiment_by_words": f"SELECT doc_id, CASE WHEN {_lexicon(NEGATIVE_WORDS)} THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN {_lexicon(NEGATIVE_WORDS)} THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS score_neg, 'keyword_proxy' AS sentiment_source FROM documents",
        "event_keyword_sentiment": f"SELECT lang, CASE WHEN {_lexicon(EVENT_NEGATIVE_WORDS)} THEN 'negative' WHEN {_lexicon(EVENT_POSITIVE_WORDS)} THEN 'positive' ELSE 'neutral' END AS label, count(*) AS n FROM documents GROUP BY 1, 2",
        "sentiment_by_video": _with(body=f" SELECT video_id, {_BLOCK} FROM all_comments GROUP BY 1"),
        "sentiment_by_theme": _with(body=f" SELECT theme, {_BLOCK} FROM (SELECT c.*, theme FROM all_comments c LEFT JOIN videos USING (video_id)) GROUP BY 1"),
        "community_sentiment": _with(body=f" SELECT community, {_BLOCK}, count(DISTINCT actor_id) AS n_actors, count(DISTINCT video_id) AS n_videos FROM in_community GROUP BY 1"),
        "community_theme_sentiment": _with(body=f" SELECT community, theme, {_BLOCK}, count(DISTINCT actor_id) AS n_actors FROM (SELECT c.*, theme FROM in_community c JOIN videos USING (video_id)) GROUP BY 1, 2"),
        "keyword_sentiment": f"""
WITH d AS (SELECT lang, {_lexicon(NEGATIVE_WORDS)} AS hit FROM documents)
SELECT lang, CASE WHEN hit THEN 'negative' ELSE 'neutral' END AS label, count(*) AS n, CAST(CASE WHEN hit THEN 0.8 ELSE 0.1 END AS DOUBLE) AS score_neg, CAST(CASE
  WHEN hit THEN 0.55 ELSE 0.35 END AS DOUBLE) AS confidence FROM d GROUP BY lang, hit""",
        "sentiment_hotspots": _with(body=f" SELECT video_id, title, theme, n, negative_rate, weighted_negative_rate FROM (SELECT video_id, {_BLOCK} FROM all_comments GROUP BY 1) JOIN videos USING (video_id) WHERE n >= 5"),
        "theme_labels_long": _with(body=" SELECT video_id, theme AS label FROM videos UNION ALL SELECT video_id, label FROM videos"),
        "theme_rules": _theme_rules(),
        "theme_summary": _with(body="""
, x AS (SELECT theme, count(*) AS nc, count(DISTINCT actor_id) AS na FROM comments JOIN videos USING (video_id) GROUP BY 1), y AS (SELECT theme, count(*) AS nv FROM videos GROUP BY 1)
SELECT theme, coalesce(nv, 0) AS n_videos, coalesce(nc, 0) AS n_comments, coalesce(na, 0) AS n_commenters FROM x FULL JOIN y USING (theme)"""),
        "community_theme_affinity": _with(body="""
, p AS (SELECT community, theme FROM actor_videos JOIN actors USING (actor_id) JOIN videos USING (video_id)),
g AS (SELECT community, theme, count(*) AS pairs FROM p GROUP BY 1, 2),
h AS (SELECT *, CAST(sum(pairs) OVER (PARTITION BY community) AS BIGINT) AS group_pairs, CAST(sum(pairs) OVER (PARTITION BY theme) AS BIGINT) AS label_pairs, sum(pairs) OVER () AS total FROM g)
SELECT community, theme, pairs, group_pairs, label_pairs, round(pairs / group_pairs, 6) AS share, round((pairs / group_pairs) / (label_pairs / total), 6) AS lift FROM h"""),
        "community_top_themes": _with(body="""
, g AS (SELECT community, theme, count(*) AS n FROM actor_videos JOIN actors USING (actor_id) JOIN videos USING (video_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, theme) AS k FROM g)
SELECT community, string_agg(substr(theme, 1, 48) || ' (' || n || ')', '; ' ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY 1"""),
        "thread_metrics": _with(_THREADS, body="""
SELECT thread_id, video_id, n, n_replies, n_actors, n_reply_actors, likes, first_at, last_at, parent_label, conflict_replies, conflict_reply_weight, conflict_thread,
  strict_reply_conflict, pile_on, parent_opposition, negative_consensus, positive_consensus,
  round(tb, 9) AS thread_bipolarity, round(rb, 9) AS reply_bipolarity, round(wb, 9) AS weighted_bipolarity, round(intensity, 9) AS conflict_intensity,
  round(intensity * n_replies, 9) AS reply_intensity, round(intensity * reply_weight, 9) AS weighted_intensity FROM threads"""),
        "reply_overview": _with(body="""
SELECT count(*) AS n_comments, count(*) FILTER (is_top_level) AS n_top_level, count(*) FILTER (NOT is_top_level) AS n_replies, count(DISTINCT thread_id) AS n_threads,
  count(DISTINCT thread_id) FILTER (NOT is_top_level) AS n_replied_threads, count(DISTINCT actor_id) AS n_commenters, count(DISTINCT actor_id) FILTER (NOT is_top_level) AS n_reply_commenters,
  round(count(*) FILTER (NOT is_top_level) / count(*), 6) AS reply_share, round(count(DISTINCT thread_id) FILTER (NOT is_top_level) / count(DISTINCT thread_id), 6) AS replied_thread_share,
  round(count(*) FILTER (NOT is_top_level AND label = 'negative') / nullif(count(*) FILTER (NOT is_top_level), 0), 6) AS reply_negative_rate FROM all_comments"""),
        "video_conflict": _with(_THREADS, body=f"""
, c AS ({_conflict("video_id").format(source="threads")}),
r AS (SELECT video_id, count(*) AS n_scored_replies, {', '.join(f"round(count(*) FILTER (label = '{x}') / count(*), 6) AS reply_{x}_rate, round(coalesce(sum(like_count + 1) FILTER (label = '{x}'), 0) / sum(like_count + 1), 6) AS reply_weighted_{x}_rate" for x in ('negative', 'positive'))}
  FROM all_comments WHERE NOT is_top_level GROUP BY 1)
SELECT c.*, coalesce(n_scored_replies, 0) AS n_scored_replies, {', '.join(f"coalesce({x}, 0) AS {x}" for x in ('reply_negative_rate', 'reply_weighted_negative_rate', 'reply_positive_rate', 'reply_weighted_positive_rate'))},
  theme, title, published_at, view_count FROM c LEFT JOIN r USING (video_id) LEFT JOIN videos USING (video_id)"""),
        "theme_conflict": _with(_THREADS, body=_conflict("theme").format(source="(SELECT t.*, theme FROM threads t JOIN videos USING (video_id))")),
        "aspect_summary": _with(_ASPECTS, body=_aspect_summary()),
        "aspect_daily": _with(_ASPECTS, body=f" SELECT * FROM ({_aspect_daily('platform, ')})"),
        "aspect_days": _with(_ASPECTS, body=f" SELECT * FROM ({_aspect_daily('')})"),
        "aspect_anomalies": _with(_ASPECTS, body=f"""
, d AS ({_aspect_daily('platform, ')}), m AS (SELECT *, avg(n_negative) OVER g AS m, stddev_pop(n_negative) OVER g AS s FROM d WINDOW g AS (PARTITION BY platform, aspect))
SELECT platform, aspect, day, n_negative, round(m, 6) AS mean, round(s, 6) AS sd, round((n_negative - m) / nullif(s, 0), 6) AS z, round(greatest(m + 2 * s, 3), 6) AS threshold
  FROM m WHERE n_negative >= greatest(m + 2 * s, 3)"""),
        "video_aspect_shares": _with(_ASPECTS, body=_shares("judged WHERE label = 'negative'", "video_id")),
        "community_aspect_shares": _with(_ASPECTS, body=_shares("judged JOIN actors USING (actor_id) WHERE label = 'negative'", "community")),
        "positive_aspect_shares": _with(_ASPECTS,
        body=" SELECT aspect, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM judged WHERE label = 'positive' GROUP BY 1"),
        "platform_aspect_shares": _with(_ASPECTS, body=_shares("aspect_rows WHERE sentiment = 'negative'", "platform")),
        "video_actionable_share": _with(_ASPECTS,
        body=" SELECT video_id, count(*) AS n, round(count(*) FILTER (aspect NOT IN ('other', 'unclear')) / count(*), 6) AS actionable FROM aspect_rows WHERE sentiment = 'negative' GROUP BY 1"),
        "scored_units": _scored_units(),
        "external_units": _external_units(),
        "top_negative_comments": _with(body="""
SELECT video_id, CAST(k AS INT) AS place, like_count, ts, thread_id, line FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY like_count DESC, ts, thread_id, line,
  actor_id) AS k FROM all_comments WHERE label = 'negative') WHERE k <= 3"""),
        "channel_metrics": _with(_metrics(), body=" SELECT * FROM metrics"),
        "report_metrics": _with(_metrics(), body=" SELECT * FROM metrics"),
        "report_documents": _with(body="""
, nat AS (SELECT s_suppkey AS supplier_id, n_name AS channel FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT * FROM in_community JOIN nat USING (supplier_id))
SELECT channel, count(DISTINCT c.video_id) AS n_videos, count(DISTINCT community) AS n_communities, count(*) AS n_comments FROM c GROUP BY channel"""),
        "metric_distributions": _with(_metrics(), body="""
SELECT metric, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS sd, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.1), 9) AS p10,
  round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS p75,
  round(quantile_cont(value, 0.9), 9) AS p90 FROM metrics GROUP BY 1"""),
        "metric_percentiles": _with(_metrics(),
        body=" SELECT *, CASE WHEN percentile >= 90 THEN 'very_high' WHEN percentile >= 75 THEN 'high' WHEN percentile <= 10 THEN 'very_low' WHEN percentile <= 25 THEN 'low' ELSE 'typical' END AS band FROM ranks"),
        "target_comparison": _with(_metrics(), body="""
, o AS (SELECT metric, value AS target FROM metrics WHERE channel = 'NATION_7')
SELECT metric, target, round(100 * avg(CASE WHEN value <= target THEN 1.0 ELSE 0.0 END), 6) AS percentile, round(quantile_cont(value, 0.5), 9) AS median,
  round(target - quantile_cont(value, 0.5), 9) AS delta, round(target / quantile_cont(value, 0.5), 9) AS ratio FROM metrics JOIN o USING (metric) GROUP BY 1, 2"""),
        "composite_indices": _with(_metrics(), body=" SELECT * FROM indices"),
        "channel_archetypes": _with(_metrics(), body="""
, w AS (PIVOT indices ON index_name IN ('engagement_conversion', 'audience_stickiness', 'conversation_quality', 'risk_pressure', 'community_concentration', 'content_portfolio_linkage') USING max(score)
  GROUP BY channel),
p AS (SELECT channel, coalesce(engagement_conversion, 0) AS e, coalesce(audience_stickiness, 0) AS s, coalesce(conversation_quality, 0) AS q, coalesce(risk_pressure, 0) AS r,
  coalesce(community_concentration, 0) AS c, coalesce(content_portfolio_linkage, 0) AS l FROM w)
SELECT channel, CASE WHEN e >= 65 AND r >= 65 THEN 'high_engagement_high_risk' WHEN e >= 65 AND s >= 60 AND r < 60 THEN 'steady_discussion'
  WHEN s >= 65 AND c >= 65 THEN 'core_circle' WHEN l >= 65 AND e >= 50 THEN 'expandable_portfolio'
  WHEN q >= 65 AND e < 45 THEN 'quiet_potential' WHEN e < 40 AND s < 40 THEN 'low_participation' ELSE 'balanced' END AS archetype FROM p"""),
        "index_hints": _with(_metrics(), body="""
SELECT *, CASE WHEN score >= 80 THEN 'very_high' WHEN score >= 65 THEN 'high' WHEN score >= 40 THEN 'middle' WHEN score >= 25 THEN 'low' ELSE 'very_low' END AS band,
  CASE index_name WHEN 'risk_pressure' THEN 'risk_high' WHEN 'community_concentration' THEN 'mixed_high'
  WHEN 'content_portfolio_linkage' THEN 'mixed_high' ELSE 'benefit_high' END AS polarity, CASE WHEN score >= 65 THEN 'high' WHEN score <= 35 THEN 'low' ELSE 'middle' END AS hint FROM indices"""),
        "metric_catalogue": _with(_metrics(), body=f"""
, d AS (SELECT metric, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS sd, min(value) AS least,
  max(value) AS most, {', '.join(f'round(quantile_cont(value, {q}), 9) AS {k}' for k, q in (('p10', 0.1), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p90', 0.9)))} FROM metrics GROUP BY 1)
SELECT *, CASE {' '.join(f"WHEN metric IN ({', '.join(repr(m) for m in names)}) THEN '{g}'" for g, names in channels_sql.GROUPS.items())} ELSE 'scale' END AS metric_group,
  CASE WHEN metric LIKE 'n$_%' ESCAPE '$' OR metric LIKE '%$_comments' ESCAPE '$' OR metric LIKE '%$_commenters' ESCAPE '$' THEN 'count'
  WHEN metric LIKE '%rate%' OR metric LIKE '%share%' OR metric LIKE '%pct%' THEN 'rate' WHEN metric LIKE '%density%' THEN 'density'
    WHEN metric LIKE '%score%' OR metric LIKE '%$_hhi' ESCAPE '$' OR metric LIKE '%modularity%' OR metric = 'top_bridge_participation_mean' THEN 'score'
    WHEN metric LIKE '%per$_video%' ESCAPE '$' THEN 'per_video' WHEN metric LIKE '%per$_1k$_views%' ESCAPE '$' THEN 'per_1k_views' ELSE 'value' END AS unit,
  {channels_sql.POLARITY_RULE} AS polarity, round(p75 - p25, 9) AS iqr FROM d"""),
        "leaderboards": _with(_metrics(), body="""
, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, channel) AS INT) AS t, CAST(row_number() OVER (PARTITION BY metric ORDER BY value, channel) AS INT) AS b FROM metrics
  WHERE metric IN ('comments_per_1k_views', 'high_mid_tier_commenter_share', 'continuity_return_rate_w4', 'community_hhi', 'negative_rate', 'like_weighted_negative_rate', 'reply_share_all_comments', 'max_video_like_weighted_conflict_score'))
SELECT metric, channel, value, 'top' AS board, t AS place FROM r WHERE t <= 5 UNION ALL SELECT metric, channel, value, 'bottom', b FROM r WHERE b <= 5"""),
        "size_bands": _with(_metrics(), body="""
, b(at_least) AS (VALUES (0), (1000), (2000)), z AS (SELECT channel, value AS size FROM metrics WHERE metric = 'all_comments')
SELECT at_least, metric, count(*) AS n, round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 9) AS sd, round(quantile_cont(value, 0.5), 9) AS median FROM metrics
  JOIN z USING (channel) JOIN b ON size >= at_least GROUP BY 1, 2"""),
        "loglog_regression": _with(body="""
, m AS (SELECT log10(view_count + 1) AS x, log10(coalesce(l, 0) + 1) AS y FROM videos LEFT JOIN (SELECT video_id, sum(like_count) AS l FROM all_comments GROUP BY 1) USING (video_id))
SELECT count(*) AS n, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM m"""),
        "theme_contrast": _with(body="""
, c AS (SELECT community, theme, count(*) AS n, round(count(*) FILTER (label = 'negative') / count(*), 6) AS r FROM (SELECT c.*, theme FROM in_community c JOIN videos USING (video_id)) GROUP BY 1, 2)
SELECT theme, count(*) AS n_communities, round(max(r) - min(r), 6) AS spread FROM c WHERE n >= 150 AND theme <> 'other' GROUP BY 1 HAVING count(*) >= 2 ORDER BY spread DESC, theme LIMIT 6"""),
        "completion_report": """
SELECT source, count(*) AS wanted, count(l.doc_id) AS done, count(*) - count(l.doc_id) AS remaining, round(count(l.doc_id) / count(*), 6) AS completion FROM documents d LEFT
  JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""",
        "channel_takeaways": _with(_metrics(), channels_sql.POLARITY, body="""
, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY x DESC, metric) AS INT) AS place FROM readings WHERE percentile <= 25 OR percentile >= 75)
SELECT channel, place, metric, percentile, reading FROM r WHERE place <= 8"""),
        "risk_opportunity": _with(_metrics(), channels_sql.POLARITY, body="""
, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel, reading ORDER BY x DESC, metric) AS INT) AS place FROM readings)
SELECT channel, reading, place, metric, percentile FROM r WHERE place <= 5"""),
        "analysis_lenses": _with(_metrics(), body="""
, l(lens, index_name) AS (VALUES ('executive', 'engagement_conversion'), ('executive', 'audience_stickiness'), ('executive', 'conversation_quality'),
  ('executive', 'risk_pressure'), ('audience', 'engagement_conversion'), ('audience', 'audience_stickiness'), ('audience', 'community_concentration'),
  ('content', 'content_portfolio_linkage'), ('content', 'engagement_conversion'), ('content', 'audience_stickiness'))
SELECT channel, lens, round(avg(score), 4) AS score, count(*) AS n_indices FROM indices JOIN l USING (index_name) GROUP BY 1, 2"""),
        "baseline_summary": _with(_metrics(), body="""
SELECT count(DISTINCT channel) AS n_channels, count(DISTINCT metric) AS n_metrics, count(*) AS n_values,
  CAST(sum(value) FILTER (metric = 'n_videos_in_scope') AS BIGINT) AS videos, CAST(sum(value) FILTER (metric = 'all_comments') AS BIGINT) AS comments,
  CAST(sum(value) FILTER (metric = 'top_level_commenters') AS BIGINT) AS commenters, (SELECT count(*) FROM ranks) AS n_percentiles FROM metrics"""),
        "shown_metrics": _with(_metrics(), body="""
SELECT channel, metric, format('{:,.0f}', value + 0.0) AS number, printf('%.3f', round(value, 3) + 0.0) AS decimal, printf('%.1f%%', round(CASE
  WHEN abs(value) <= 1 THEN value * 100 ELSE value END, 1) + 0.0) AS rate, CASE WHEN percentile >= 66.7 THEN 'high' WHEN percentile >= 33.3 THEN 'middle' ELSE 'low' END AS third FROM ranks"""),
        "channel_documents": _with(_metrics(), channels_sql.POLARITY, body="""
, own AS (SELECT channel, CAST(count(*) AS INT) AS n_metrics FROM metrics GROUP BY 1),
b AS (SELECT channel, arg_max(index_name, {s: score, i: index_name}) AS best_index, arg_min(index_name, {s: score, i: index_name}) AS worst_index FROM indices GROUP BY 1),
r AS (SELECT channel, count(*) FILTER (reading = 'risk') AS n_risk, count(*) FILTER (reading = 'opportunity') AS n_opportunity, count(*) FILTER (reading = 'watch') AS n_watch,
  count(*) FILTER (reading = 'context') AS n_context FROM readings GROUP BY 1),
k AS (SELECT channel, index_name, CASE WHEN (index_name = 'risk_pressure') = (score >= 65) THEN 60 ELSE 50 END + abs(score - 50) AS p FROM indices WHERE score >= 65 OR score <= 35),
q AS (SELECT channel, string_agg(index_name, ';' ORDER BY i) AS decision_queue FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(p, 4) DESC, index_name) AS i
  FROM k) WHERE i <= 5 GROUP BY 1),
w AS (PIVOT indices ON index_name IN ('engagement_conversion', 'audience_stickiness', 'conversation_quality', 'risk_pressure', 'community_concentration', 'content_portfolio_linkage') USING max(score)
  GROUP BY channel),
z AS (SELECT channel, coalesce(engagement_conversion, 0) AS e, coalesce(audience_stickiness, 0) AS s, coalesce(conversation_quality, 0) AS q, coalesce(risk_pressure, 0) AS r,
  coalesce(community_concentration, 0) AS c, coalesce(content_portfolio_linkage, 0) AS l FROM w),
a AS (SELECT channel, CASE WHEN e >= 65 AND r >= 65 THEN 'high_engagement_high_risk' WHEN e >= 65 AND s >= 60 AND r < 60 THEN 'steady_discussion'
  WHEN s >= 65 AND c >= 65 THEN 'core_circle' WHEN l >= 65 AND e >= 50 THEN 'expandable_portfolio'
  WHEN q >= 65 AND e < 45 THEN 'quiet_potential' WHEN e < 40 AND s < 40 THEN 'low_participation' ELSE 'balanced' END AS archetype FROM z)
SELECT * FROM own LEFT JOIN a USING (channel) LEFT JOIN b USING (channel) LEFT JOIN r USING (channel) LEFT JOIN q USING (channel)"""),
        "community_mood": _with(body=f"""
, b AS (SELECT community, {_BLOCK} FROM in_community GROUP BY 1), d AS (SELECT *, CASE WHEN negative_rate >= neutral_rate AND negative_rate >= positive_rate THEN 'negative'
  WHEN neutral_rate >= positive_rate THEN 'neutral' ELSE 'positive' END AS dominant FROM b)
SELECT community, dominant, CASE WHEN dominant = 'positive' AND negative_rate < 0.1 THEN 'mostly_positive' WHEN dominant = 'positive' THEN 'positive_but_watch_negative'
  WHEN dominant = 'neutral' THEN 'mostly_neutral' ELSE 'negative_high' END AS sentiment_reading, negative_rate, neutral_rate, positive_rate, weighted_negative_rate, weighted_positive_rate FROM d"""),
        "negative_sources": _with(body=f"""
, b AS (SELECT theme, {_BLOCK} FROM (SELECT c.*, theme FROM all_comments c LEFT JOIN videos USING (video_id)) GROUP BY 1), r AS (SELECT *,
  CAST(row_number() OVER (ORDER BY weighted_negative_rate DESC, n DESC, theme) AS INT) AS place FROM b WHERE n >= 50)
SELECT place, theme, n, negative_rate, weighted_negative_rate, printf('%.1f%%', negative_rate * 100) AS shown FROM r WHERE place <= 3"""),
        "ranked_theme_items": _with(body="""
, g AS (SELECT community, theme, count(*) AS n FROM actor_videos JOIN actors USING (actor_id) JOIN videos USING (video_id) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY community ORDER BY n DESC, theme) AS INT) - 1 AS place FROM g)
SELECT community, place, theme AS label, CAST(n AS DOUBLE) AS count FROM r WHERE place < 5"""),
        "metric_positions": _with(_metrics(), body="""
, d AS (SELECT metric, [min(value), round(quantile_cont(value, 0.1), 9), round(quantile_cont(value, 0.25), 9), round(quantile_cont(value, 0.5), 9),
  round(quantile_cont(value, 0.75), 9), round(quantile_cont(value, 0.9), 9), max(value)] AS q FROM metrics GROUP BY 1),
e AS (SELECT m.*, q, [0, 10, 25, 50, 75, 90, 100] AS p, CASE WHEN value <= q[1] THEN 1 WHEN value <= q[2] THEN 2 WHEN value <= q[3] THEN 3 WHEN value <= q[4] THEN 4
  WHEN value <= q[5] THEN 5 WHEN value <= q[6] THEN 6 WHEN value <= q[7] THEN 7 ELSE 8 END AS k FROM metrics m JOIN d USING (metric))
SELECT channel, metric, value, round(CASE WHEN k = 1 THEN 0 WHEN k = 8 THEN 100 ELSE p[k - 1] + (p[k] - p[k - 1]) * coalesce((value - q[k - 1]) / nullif(q[k] - q[k - 1], 0), 0) END, 4) AS position,
  round((value - q[4]) / nullif(q[5] - q[3], 0), 4) AS iqr_distance, CASE WHEN value < q[3] THEN 'below_iqr' WHEN value > q[5] THEN 'above_iqr' ELSE 'inside_iqr' END AS part FROM e"""),
        "engagement_table": _with(body="""
SELECT video_id, title, coalesce(n, 0) AS n_comments, view_count, round(1000 * coalesce(n, 0) / nullif(view_count, 0), 6) AS per_1k_views FROM videos LEFT JOIN (SELECT video_id,
  count(*) AS n FROM all_comments GROUP BY 1) USING (video_id) ORDER BY per_1k_views DESC NULLS LAST, video_id LIMIT 12"""),
        "risk_videos": _with(_ASPECTS, body=f"""
, b AS (SELECT video_id, {_BLOCK} FROM all_comments GROUP BY 1),
x AS (SELECT video_id, round(count(*) FILTER (aspect NOT IN ('other', 'unclear')) / count(*), 6) AS actionable FROM aspect_rows WHERE sentiment = 'negative' GROUP BY 1)
SELECT video_id, n, negative_rate, weighted_negative_rate, actionable,
  round(CASE WHEN weighted_negative_rate > 0 THEN weighted_negative_rate ELSE negative_rate END * coalesce(actionable, 1), 6) AS score FROM b LEFT JOIN x USING (video_id)
WHERE n >= 25 OR (SELECT max(n) FROM b) < 25 ORDER BY score DESC, video_id LIMIT 6"""),
        "theme_overview": _with(_THREADS, body=f"""
, x AS (SELECT theme, count(*) AS n_comments, count(DISTINCT actor_id) AS n_commenters FROM comments JOIN videos USING (video_id) GROUP BY 1), y AS (SELECT theme,
  count(*) AS n_videos, CAST(sum(view_count) AS BIGINT) AS views FROM videos GROUP BY 1),
z AS (SELECT theme, {_BLOCK} FROM (SELECT c.*, theme FROM all_comments c JOIN videos USING (video_id)) GROUP BY 1),
  c AS ({_conflict('theme').format(source='(SELECT t.*, theme FROM threads t JOIN videos USING (video_id))')})
SELECT theme, n_videos, n_comments, n_commenters, negative_rate, positive_rate, conflict_rate_replied, conflict_score, views,
  round(1000 * n_comments / nullif(views, 0), 6) AS per_1k_views FROM y JOIN x USING (theme) JOIN z USING (theme) JOIN c USING (theme)"""),
        "segment_profiles": _with(body=f"""
, s AS (SELECT community, {_BLOCK}, count(DISTINCT actor_id) AS n_actors FROM in_community GROUP BY 1),
g AS (SELECT community, theme, count(*) AS pairs FROM actor_videos JOIN actors USING (actor_id) JOIN videos USING (video_id) GROUP BY 1, 2),
h AS (SELECT community, theme, round((pairs / sum(pairs) OVER (PARTITION BY community)) / (sum(pairs) OVER (PARTITION BY theme) / sum(pairs) OVER ()), 6) AS lift FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY lift DESC, theme) AS k FROM h),
t AS (SELECT community, string_agg(theme, ';' ORDER BY k) AS top_labels FROM r WHERE k <= 3 GROUP BY 1)
SELECT community, n, n_actors, round(n / n_actors, 6) AS comments_per_commenter,
  list_reverse_sort([{{n: n_negative, label: 'negative'}}, {{n: n_neutral, label: 'neutral'}}, {{n: n_positive, label: 'positive'}}])[1].label AS dominant, top_labels FROM s LEFT
  JOIN t USING (community)"""),
        "likes_outliers": _with(body="""
, m AS (SELECT video_id, view_count, coalesce(l, 0) AS likes, log10(view_count + 1) AS x, log10(coalesce(l, 0) + 1) AS y FROM videos LEFT JOIN (SELECT video_id,
  CAST(sum(like_count) AS BIGINT) AS l FROM all_comments GROUP BY 1) USING (video_id)),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, quantile_cont(view_count, 0.1) AS p10 FROM m), r AS (SELECT m.*, p10, y - a - b * x AS r FROM m, f),
  s AS (SELECT sqrt(sum(r * r) / (count(*) - 2)) AS sd FROM r)
SELECT video_id, view_count, likes, round(r / sd, 4) AS z, round(10 ** r, 4) AS lift FROM r, s WHERE view_count >= greatest(1000, p10) ORDER BY abs(round(r / sd, 4)) DESC, video_id LIMIT 8"""),
        "queue_status": _QUEUE + "SELECT status, count(*) AS n, count(DISTINCT video_id) AS n_videos, count(last_error) AS n_errors, max(updated_at) AS last_update FROM q GROUP BY 1",
        "queue_after_reset": _QUEUE + """
, r AS (SELECT video_id, status = 'failed' AND lower(last_error) LIKE '%quota%' AS again, status, last_error, updated_at FROM q)
SELECT CASE WHEN again THEN 'queued' ELSE status END AS status, count(*) AS n, count(DISTINCT video_id) AS n_videos, count(last_error) FILTER (NOT again) AS n_errors, max(CASE
  WHEN again THEN TIMESTAMP '2002-01-01' ELSE updated_at END) AS last_update FROM r GROUP BY 1""",
        "remaining_units": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0)",
        "runtime_estimates": _with(body="""
SELECT 'video' AS stage, count(*) AS units, CAST(60 + ceil(60 * count(*) / 40) AS BIGINT) AS low_seconds, CAST(60 + ceil(60 * count(*) / 20) AS BIGINT) AS high_seconds FROM videos
UNION ALL SELECT 'sentiment', count(*), CAST(60 + ceil(60 * count(*) / 650) AS BIGINT), CAST(60 + ceil(60 * count(*) / 450) AS BIGINT) FROM all_comments"""),
        "shown_estimates": _with(body=f"""
, u AS (SELECT 'video' AS stage, 60 + ceil(60 * count(*) / 40) AS low, 60 + ceil(60 * count(*) / 20) AS high
  FROM videos UNION ALL SELECT 'sentiment', 60 + ceil(60 * count(*) / 650), 60 + ceil(60 * count(*) / 450) FROM all_comments)
SELECT stage, CASE WHEN abs(high - low) < 1 THEN {_duration('high')} ELSE {_duration('low')} || ' to ' || {_duration('high')} END AS shown FROM u"""),
        "video_theme_labels": _with(body=_label_videos() + " SELECT * FROM labelled"),
        "theme_source_summary": _with(body=_label_videos() + " SELECT theme_source, count(*) AS n_videos FROM labelled GROUP BY 1"),
        "sliding_topic_counts": """
WITH w AS (SELECT event_type AS topic, date_trunc('day', ts) + to_hours(2 * CAST(floor(hour(ts) / 2) AS BIGINT)) AS last, ts FROM events),
s AS (SELECT topic, last - to_hours(2 * k) AS started_at FROM w, range(3) t(k))
SELECT started_at, started_at + INTERVAL 6 HOUR AS ended_at, topic, count(*) AS n_posts FROM s GROUP BY ALL""",
        "posts_followed": "SELECT a.user_id AS author, a.ts AS first_at, a.event_id AS first_id, b.ts AS second_at, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR",
        "daily_topic_counts": "SELECT CAST(ts AS DATE) AS day, event_type AS topic, count(*) AS n_posts, round(sum(value), 2) AS engagement FROM events GROUP BY 1, 2",
        "author_sessions": """
WITH g AS (SELECT user_id AS author, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY author ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT author, min(ts) AS started_at, max(ts) + INTERVAL 3 HOUR AS ended_at, count(*) AS n_posts FROM r GROUP BY author, run""",
        "sentiment_cube": _with(body="""
SELECT community, theme, CAST(grouping(community, theme) AS INT) AS level, count(*) AS n, count(*) FILTER (label = 'negative') AS n_negative FROM (SELECT c.*, theme
  FROM in_community c JOIN videos USING (video_id)) GROUP BY CUBE (community, theme)"""),
        "comment_gaps": _with(body="""
, g AS (SELECT actor_id, CAST(ts AS DATE) - CAST(lag(ts) OVER (PARTITION BY actor_id ORDER BY ts) AS DATE) AS gap FROM all_comments)
SELECT actor_id, count(gap) AS n_gaps, CAST(max(gap) AS INT) AS longest FROM g GROUP BY 1"""),
        "metric_spotlight": _with(_metrics(), body="""
, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, channel) AS h, row_number() OVER (PARTITION BY metric ORDER BY value, channel) AS l FROM metrics)
SELECT metric, string_agg(channel, ';' ORDER BY h) FILTER (h <= 3) AS highest, string_agg(channel, ';' ORDER BY l) FILTER (l <= 3) AS lowest, count(*) AS n,
  round(quantile_cont(value, 0.5), 9) AS median FROM r GROUP BY 1"""),
        "story_cards": _with(_metrics(), body="""
, k AS (SELECT *, CASE WHEN (index_name = 'risk_pressure') = (score >= 65) THEN 'risk' ELSE 'strength' END AS kind FROM indices WHERE score >= 65 OR score <= 35),
q AS (SELECT *, round(CASE kind WHEN 'risk' THEN 60 ELSE 50 END + abs(score - 50), 4) AS priority FROM k),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY priority DESC, index_name) AS INT) AS place FROM q)
SELECT channel, place, index_name, kind, priority, place <= 5 AS decide FROM r WHERE place <= 9"""),
        "video_timeline": _with(body=f"""
, happenings(event_id, s) AS (VALUES (0, DATE '1996-07-01'), (1, DATE '1997-10-01'), (2, DATE '1999-01-01'), (3, DATE '2000-04-01'), (4, DATE '2001-07-01')),
n AS (SELECT video_id, count(*) AS n FROM comments GROUP BY 1), b AS (SELECT video_id, {_BLOCK} FROM all_comments GROUP BY 1),
e AS (SELECT video_id, string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY CAST(event_id AS VARCHAR)) AS events FROM videos JOIN happenings ON CAST(published_at AS DATE) BETWEEN s - 7 AND s GROUP BY 1)
SELECT v.video_id, CAST(published_at AS DATE) AS day, coalesce(n.n, 0) AS n_comments, view_count, negative_rate, events FROM videos v LEFT JOIN n USING (video_id) LEFT
  JOIN b USING (video_id) LEFT JOIN e USING (video_id)"""),
        "label_coverage": "SELECT count(*) AS n_scope, count(l.doc_id) AS n_labelled, round(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
        "video_extremes": _with(body=f"""
, b AS (SELECT video_id, {_BLOCK} FROM all_comments GROUP BY 1 HAVING count(*) >= 10),
r AS (SELECT video_id, n, positive_rate, negative_rate, CAST(row_number() OVER (ORDER BY positive_rate DESC, n DESC, video_id) AS INT) AS p,
  CAST(row_number() OVER (ORDER BY negative_rate DESC, n DESC, video_id) AS INT) AS q FROM b)
SELECT 'positive' AS side, p AS place, video_id, n, positive_rate AS rate FROM r WHERE p <= 5 UNION ALL SELECT 'negative', q, video_id, n, negative_rate FROM r WHERE q <= 5"""),
        "conversation_turns": """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN text IS NULL THEN NULL ELSE len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) END AS words FROM conversations)
SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, CAST(coalesce(sum(words) FILTER (turn = 0), 0) AS BIGINT) AS parent_words,
  CAST(coalesce(sum(words) FILTER (turn > 0), 0) AS BIGINT) AS reply_words FROM c GROUP BY 1""",
        "scalar_functions": """
WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, (k % 3) * 3600 + k * 60 AS seconds, -1 AS bad, CASE k % 3 WHEN 0 THEN 'handle:name'
  WHEN 1 THEN 'channel:name' ELSE 'last:name' END || k AS channel, 'a ' || event_type AS text, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind,
  k % 2 = 1 AS odd FROM e""",
    }
    return found | {"diagnostics": _diagnostics(found)}

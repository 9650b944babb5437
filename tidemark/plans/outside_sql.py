"""SQL of the relations of outside events, written from their definitions apart from the DataFrame code."""

from __future__ import annotations

POSTS = """
e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
posts AS (
  SELECT CAST(event_id AS VARCHAR) AS post_uid, ts, CAST(ts AS DATE) AS day, event_type AS topic, concat_ws(' ', event_type, event_id) AS title, value AS engagement,
         CASE WHEN user_id % 2 = 0 THEN 'forum_a' ELSE 'forum_b' END AS source, k >= 97 AS hint, user_id % 5 = 0 AS semantic, k <> 0 AS relevant, k = 1 AS noise
  FROM e),
good AS (SELECT * FROM posts WHERE relevant AND NOT noise)
"""
SUMS = """
  count(*) AS n_posts, round(sum(engagement), 2) AS engagement, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT topic, ';' ORDER BY topic) AS topics,
  count(*) FILTER (semantic) AS n_semantic, count(*) FILTER (hint) AS n_hints
"""
DAILY = f"""
mode AS (SELECT day, topic, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, topic) AS r FROM good GROUP BY 1, 2),
titled AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, source, title, post_uid) AS r FROM good),
titles AS (SELECT day, string_agg(title, ' || ' ORDER BY r) AS top_titles FROM titled WHERE r <= 4 GROUP BY 1),
daily AS (SELECT d.*, m.topic AS top_topic, top_titles FROM (SELECT day, {SUMS} FROM good GROUP BY 1) d JOIN mode m ON m.day = d.day AND m.r = 1 JOIN titles t ON t.day = d.day)
"""
#: The CTE that every relation of posts begins with, but for its source.
GOOD = "good AS (SELECT * FROM posts WHERE relevant AND NOT noise)"
WEAK = "('general', 'recommendation_or_general_mentions', 'survey_or_spam')"


def _strong(topic: str) -> str:
    """With the default thresholds: two posts a day, one an event, engagement of ten."""
    return f"(n_hints > 0 OR sources LIKE '%,%' OR engagement >= 10 OR CASE WHEN {topic} IN {WEAK} THEN n_posts >= 4 ELSE n_posts >= 2 END)"


CANDIDATES = f"candidates AS (SELECT * FROM daily WHERE {_strong('top_topic')})"


def _votes(rows: str, by: str) -> str:
    priority = "CASE topic WHEN 'political_or_social_controversy' THEN 90 WHEN 'content_authenticity_question' THEN 85 WHEN 'authenticity_or_fabrication' THEN 85 WHEN 'controversy_or_apology' THEN 80 WHEN 'controversy_or_criticism' THEN 80 WHEN 'staff_or_host_change' THEN 70 WHEN 'content_quality_criticism' THEN 65 WHEN 'politics_or_culture' THEN 60 WHEN 'recommendation_or_general_mentions' THEN 20 WHEN 'general' THEN 10 ELSE 40 END"
    return f"""
weights AS (
  SELECT {by}, coalesce(nullif(trim(topic), ''), 'general') AS topic, round(sum(1 + ln(1 + greatest(0, engagement)) + CASE WHEN hint THEN 25 ELSE 0 END + CASE
  WHEN semantic THEN 5 ELSE 0 END), 4) AS votes
  FROM {rows} WHERE topic <> 'survey_or_spam' GROUP BY 1, 2),
voted AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY topic NOT IN {WEAK} DESC, votes DESC, {priority} DESC, topic DESC) AS i FROM weights)
"""


def _clusters(merged: bool) -> str:
    part = "" if merged else "PARTITION BY top_topic"
    run = "CAST(sum(fresh) OVER (ORDER BY day) AS VARCHAR)" if merged else "top_topic || '#' || sum(fresh) OVER (PARTITION BY top_topic ORDER BY day)"
    if merged:
        chosen = f"{_votes('held', 'run')}, topics AS (SELECT run, coalesce(v.topic, f.t) AS event_topic FROM frame f LEFT JOIN (SELECT * FROM voted WHERE i = 1) v USING (run)), chosen AS (SELECT * FROM held)"
    else:
        chosen = f"""
own AS (SELECT run, {SUMS} FROM held WHERE topic = t GROUP BY 1),
topics AS (SELECT run, CASE WHEN NOT coalesce(n_posts >= 2 OR sources LIKE '%,%' OR engagement >= 10 OR n_hints > 0,
  false) AND all_posts >= 2 THEN 'mixed_external_discussion' ELSE t END AS event_topic FROM frame LEFT JOIN own USING (run)),
chosen AS (SELECT h.* FROM held h JOIN topics USING (run) WHERE event_topic = 'mixed_external_discussion' OR topic = event_topic)"""
    return f"""
marked AS (SELECT *, CASE WHEN day - lag(day) OVER ({part} ORDER BY day) <= 3 THEN 0 ELSE 1 END AS fresh FROM candidates),
runs AS (SELECT *, {run} AS run FROM marked),
peaks AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n_posts DESC, engagement DESC, day) AS p FROM runs),
frame AS (SELECT run, min(day) AS event_start, max(day) AS event_end, max(day) FILTER (p = 1) AS event_date, max(top_topic) FILTER (p = 1) AS t, sum(n_posts) AS all_posts FROM peaks GROUP BY 1),
held AS (SELECT f.run, f.t, g.* FROM good g JOIN frame f ON g.day BETWEEN f.event_start AND f.event_end),
{chosen},
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, source, title, post_uid) AS r FROM chosen),
lists AS (SELECT run, string_agg(title, ' || ' ORDER BY r) FILTER (r <= 5) AS top_titles, string_agg(post_uid, ';' ORDER BY r) FILTER (r <= 20) AS post_uids FROM placed GROUP BY 1),
clusters AS (
  SELECT * FROM (SELECT run, event_start, event_end, event_date, event_topic FROM frame JOIN topics USING (run)) JOIN (SELECT run, {SUMS} FROM chosen GROUP BY 1) USING (run) JOIN lists USING (run)
  WHERE {_strong('event_topic')}),
numbered AS (SELECT *, 'external_event_' || lpad(CAST(row_number() OVER (ORDER BY event_start, n_posts DESC, engagement DESC, run) AS VARCHAR), 3, '0') AS event_id FROM clusters)
"""


_CLUSTER_COLUMNS = "event_id, event_start, event_end, event_date, event_topic, sources, n_posts, engagement, n_semantic, n_hints, top_titles, post_uids"

EVENTS = """
happenings(event_id, s) AS (VALUES (0, DATE '1996-07-01'), (1, DATE '1997-10-01'), (2, DATE '1999-01-01'), (3, DATE '2000-04-01'), (4, DATE '2001-07-01')),
spans AS (
  SELECT event_id, s, w, s + a AS a, s + b AS b FROM happenings,
    (VALUES ('baseline', -118, -28), ('pre', -28, 0), ('post', 0, 28), ('follow', 28, 56)) AS t(w, a, b)),
held AS (SELECT c.*, event_id, s, w, like_count + 1 AS heavy FROM all_comments c JOIN spans ON c.ts >= a AND c.ts < b)
"""


def _p(z: str) -> str:
    """erfc(|z| / sqrt 2) by the Chebyshev fit that the DataFrame code names."""
    x = f"(abs({z}) / 1.4142135623730951)"
    t = f"(1 / (1 + 0.5 * {x}))"
    power = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        power = f"({power} * {t} + ({c}))"
    return f"{t} * exp(-{x} * {x} + {power})"


def _tests(rows: str, name: str, tests: list[tuple[str, str, str, str, str]]) -> str:
    """rows with z and p of each (prefix, k1, n1, k2, n2): sample 2 against sample 1."""
    spread = lambda k1, n1, k2, n2: f"sqrt((({k1} + {k2}) / nullif({n1} + {n2}, 0)) * (1 - ({k1} + {k2}) / nullif({n1} + {n2}, 0)) * (1 / nullif({n1}, 0) + 1 / nullif({n2}, 0)))"
    zs = ", ".join(f"CASE WHEN {spread(*t)} > 0 THEN ({t[2]} / {t[3]} - {t[0]} / {t[1]}) / {spread(*t)} END AS {prefix}_raw" for prefix, *t in tests)
    ps = ", ".join(f"round({prefix}_raw, 6) AS {prefix}_z, round({_p(prefix + '_raw')}, 6) AS {prefix}_p" for prefix, *_ in tests)
    raws = ", ".join(f"{prefix}_raw" for prefix, *_ in tests)
    return f"{name} AS (SELECT * EXCLUDE ({raws}), {ps} FROM (SELECT *, {zs} FROM {rows}))"


_W = ("baseline", "pre", "post")
WINDOWS = f"""
sums AS (SELECT event_id, {', '.join(f"count(*) FILTER (w = '{w}') AS {w}_c, count(*) FILTER (w = '{w}' AND label = 'negative') AS {w}_neg, sum(heavy) FILTER (w = '{w}') AS {w}_w, coalesce(sum(heavy) FILTER (w = '{w}' AND label = 'negative'), 0) AS {w}_wneg" for w in _W)}
  FROM held GROUP BY 1),
rates AS (SELECT event_id, {', '.join(f"coalesce({w}_c, 0) AS {w}_n, {w}_c, {w}_neg, {w}_neg / nullif({w}_c, 0) AS {w}_r, {w}_wneg / {w}_w AS {w}_h" for w in _W)} FROM happenings
  LEFT JOIN sums USING (event_id)),
{_tests('rates', 'tested', [('pre', 'pre_neg', 'pre_c', 'post_neg', 'post_c'), ('baseline', 'baseline_neg', 'baseline_c', 'post_neg', 'post_c')])},
windows AS (
  SELECT event_id, {', '.join(f"{w}_n, round({w}_r, 6) AS {w}_negative_rate, round({w}_h, 6) AS {w}_weighted_negative_rate" for w in _W)},
    round(post_c / nullif(pre_c, 0), 6) AS count_ratio, round((post_c / 28) / nullif(baseline_c / 90, 0), 6) AS volume_lift,
    round(100 * (post_r - pre_r), 6) AS delta_pre_pp, round(100 * (post_r - baseline_r), 6) AS delta_pp, round(100 * (post_h - pre_h), 6) AS weighted_delta_pre_pp,
    round(100 * (post_h - baseline_h), 6) AS weighted_delta_pp,
    pre_z, pre_p, baseline_z, baseline_p, round(baseline_h / nullif(baseline_r, 0), 6) AS baseline_amplification, round(post_h / nullif(post_r, 0), 6) AS amplification,
    round((post_h / nullif(post_r, 0)) / nullif(baseline_h / nullif(baseline_r, 0), 0), 6) AS amplification_lift
  FROM tested)
"""
AUDIENCE = f"""
top AS (SELECT * FROM held WHERE is_top_level),
firsts AS (SELECT actor_id, CAST(min(ts) AS DATE) AS first FROM comments GROUP BY 1),
seen AS (SELECT event_id, s, actor_id, {', '.join(f"count(*) FILTER (w = '{w}') AS {w}_k" for w in (*_W, 'follow'))} FROM top GROUP BY 1, 2, 3),
flags AS (SELECT *, baseline_k > 0 AND first >= s - 118 AND first < s - 28 AS baseline_f, pre_k > 0 AND first >= s - 28 AND first < s AS pre_f,
  post_k > 0 AND first >= s AND first < s + 28 AS post_f FROM seen JOIN firsts USING (actor_id)),
counts AS (
  SELECT event_id, {', '.join(f"count(*) FILTER ({w}_k > 0) AS {w}_a, count(*) FILTER ({w}_f) AS {w}_b" for w in _W)}, sum(post_k) AS all_comments_after,
  coalesce(sum(post_k) FILTER (post_f), 0) AS fresh_comments, count(*) FILTER (post_f AND follow_k > 0) AS came_back
  FROM flags GROUP BY 1),
shares AS (SELECT *, {', '.join(f"{w}_b / nullif({w}_a, 0) AS {w}_r" for w in _W)} FROM happenings LEFT JOIN counts USING (event_id)),
{_tests('shares', 'audience_tested', [('new_pre', 'pre_b', 'pre_a', 'post_b', 'post_a'), ('new', 'baseline_b', 'baseline_a', 'post_b', 'post_a')])},
ended AS (SELECT max(ts) AS last FROM comments),
audience AS (
  SELECT event_id, {', '.join(f"coalesce({w}_a, 0) AS {w}_active, coalesce({w}_b, 0) AS {w}_new, round({w}_r, 6) AS {w}_new_share" for w in _W)},
    round(100 * (post_r - pre_r), 6) AS new_delta_pre_pp, round(100 * (post_r - baseline_r), 6) AS new_delta_pp, new_pre_z, new_pre_p, new_z, new_p,
    CAST(coalesce(fresh_comments, 0) AS BIGINT) AS new_comments, round(fresh_comments / nullif(all_comments_after, 0), 6) AS new_comment_share, coalesce(came_back, 0) AS returned,
    round(came_back / nullif(post_b, 0), 6) AS newcomer_return_rate,
    CAST(greatest(0, ceil((epoch(least(last, CAST(s + 56 AS TIMESTAMP))) - epoch(CAST(s + 28 AS TIMESTAMP))) / 86400)) AS INT) AS follow_days, last >= CAST(s + 56 AS TIMESTAMP) AS follow_complete
  FROM audience_tested, ended)
"""
NEWCOMERS = """
arrivals AS (SELECT actor_id, CAST(min(ts) AS DATE) AS arrived FROM comments GROUP BY 1),
after AS (SELECT event_id, label, heavy, arrived >= s AS fresh FROM held JOIN arrivals USING (actor_id) WHERE w = 'post' AND is_top_level),
parts AS (
  SELECT event_id, count(*) FILTER (fresh) AS a, count(*) FILTER (NOT fresh) AS b, count(*) FILTER (fresh AND label = 'negative') AS an, count(*) FILTER (NOT fresh AND label = 'negative') AS bn,
    sum(heavy) FILTER (fresh) AS aw, sum(heavy) FILTER (NOT fresh) AS bw, coalesce(sum(heavy) FILTER (fresh AND label = 'negative'), 0) AS awn,
    coalesce(sum(heavy) FILTER (NOT fresh AND label = 'negative'), 0) AS bwn
  FROM after GROUP BY 1),
newcomers AS (
  SELECT event_id, coalesce(a, 0) AS n_new, coalesce(b, 0) AS n_old, round(an / nullif(a, 0), 6) AS new_negative_rate, round(bn / nullif(b, 0), 6) AS old_negative_rate,
  round(100 * (an / nullif(a, 0) - bn / nullif(b, 0)), 6) AS gap_pp,
    round(awn / aw, 6) AS new_weighted_negative_rate, round(bwn / bw, 6) AS old_weighted_negative_rate, round(100 * (awn / aw - bwn / bw), 6) AS weighted_gap_pp
  FROM happenings LEFT JOIN parts USING (event_id))
"""
CONFLICTS = """
began AS (SELECT thread_id, min(ts) AS ts FROM all_comments GROUP BY 1),
clash AS (SELECT event_id, w, t.* FROM threads t JOIN began USING (thread_id) JOIN spans ON began.ts >= a AND began.ts < b WHERE w <> 'follow'),
clashes AS (SELECT event_id, w, count(*) AS n, count(*) FILTER (n_replies > 0) AS r, count(*) FILTER (conflict_thread) AS c, count(*) FILTER (pile_on) AS p,
  count(*) FILTER (parent_opposition) AS o FROM clash GROUP BY 1, 2),
conflicts AS (
  SELECT s.event_id, s.w AS "window", coalesce(n, 0) AS n_threads, coalesce(r, 0) AS n_replied, coalesce(c, 0) AS n_conflict, coalesce(p, 0) AS n_pile_on, coalesce(o, 0) AS n_opposition,
    round(c / nullif(r, 0), 6) AS conflict_rate, round(coalesce(c * (c / nullif(r, 0)), 0), 6) AS conflict_score
  FROM spans s LEFT JOIN clashes k ON k.event_id = s.event_id AND k.w = s.w WHERE s.w <> 'follow'),
lift AS (
  SELECT event_id, max(conflict_score) FILTER ("window" = 'baseline') AS baseline_conflict, max(conflict_score) FILTER ("window" = 'post') AS post_conflict,
  max(n_pile_on) FILTER ("window" = 'post') AS post_pile_on, max(n_opposition) FILTER ("window" = 'post') AS post_opposition
  FROM conflicts GROUP BY 1),
lifts AS (SELECT *, round(post_conflict - baseline_conflict, 6) AS conflict_delta, round(post_conflict / nullif(baseline_conflict, 0), 6) AS conflict_lift FROM lift)
"""
SPILL = """
calm AS (SELECT event_id, count(*) FILTER (label = 'negative') / count(*) AS base FROM held WHERE w = 'baseline' GROUP BY 1),
touched AS (SELECT event_id, s, video_id, count(*) AS n, count(*) FILTER (label = 'negative') / count(*) AS rate FROM held WHERE w = 'post' GROUP BY 1, 2, 3),
judged AS (SELECT t.event_id, n >= 2 AND rate >= base + 0.05 AS hit, published_at >= s - 7 AND published_at < s + 8 AS near FROM touched t JOIN calm USING (event_id) JOIN videos USING (video_id)),
spill AS (
  SELECT event_id, count(hit) AS n_videos, count(*) FILTER (hit) AS n_affected, count(*) FILTER (hit AND near) AS n_near, count(*) FILTER (hit AND NOT near) AS n_other,
  round(count(*) FILTER (hit AND NOT near) / nullif(count(*) FILTER (hit AND near), 0), 6) AS spillover_ratio
  FROM happenings LEFT JOIN judged USING (event_id) GROUP BY 1)
"""


def clusters_of(posts: str) -> str:
    """SQL of the clusters of other posts; posts: CTEs, the last of which is called so."""
    return "WITH " + ", ".join(p.strip() for p in (posts, GOOD, DAILY, CANDIDATES, _clusters(False))) + f" SELECT {_CLUSTER_COLUMNS} FROM numbered"


def sql(views: str, threads: str) -> dict[str, str]:
    """SQL by query name; views: the CTEs of comments and videos; threads: those of the threads."""
    posts = lambda *parts, body: "WITH " + ", ".join(p.strip() for p in (POSTS, *parts)) + body
    facts = lambda *parts, body: "WITH " + ", ".join(p.strip() for p in (views, *parts)) + body
    flags = ", ".join(f"coalesce({v}, false) AS {k}" for k, v in (("negative_response", "delta_pp >= 3 AND baseline_p < 0.05"),
        ("new_audience", "new_delta_pp >= 2 AND new_p < 0.05"), ("newcomer_negative", "gap_pp >= 3"), ("conflict", "conflict_lift >= 2"),
        ("spillover", "spillover_ratio > 1")))
    names = [("negative_response", "negative_response_above_baseline"), ("new_audience", "new_audience_entry_above_baseline"),
        ("newcomer_negative", "new_commenters_more_negative"), ("conflict", "reply_conflict_lift"),
        ("spillover", "negative_spillover_beyond_event_nearby_videos")]
    listed = ", ".join(f"CASE WHEN {k} THEN '{v}' END" for k, v in names)
    days = "c(event_id, s, e) AS (VALUES (0, DATE '2024-01-01', DATE '2024-01-09'), (1, DATE '2024-01-10', DATE '2024-01-19'), (2, DATE '2024-01-20', DATE '2024-01-30')), rows AS (SELECT c.event_id, p.* FROM posts p JOIN c ON p.day BETWEEN c.s AND c.e)"
    return {
        "external_daily": posts(DAILY, body=" SELECT * FROM daily"),
        "candidate_days": posts(DAILY, CANDIDATES, body=" SELECT * FROM candidates"),
        "event_clusters": posts(DAILY, CANDIDATES, _clusters(False), body=f" SELECT {_CLUSTER_COLUMNS} FROM numbered"),
        "merged_event_clusters": posts(DAILY, CANDIDATES, _clusters(True), body=f" SELECT {_CLUSTER_COLUMNS} FROM numbered"),
        "external_summary": posts(DAILY, CANDIDATES, _clusters(False), body="""
SELECT 'ok' AS status, count(*) AS n_posts, count(*) FILTER (relevant) AS n_relevant, count(*) FILTER (semantic) AS n_semantic, count(*) FILTER (noise) AS n_noise, count(DISTINCT day) AS n_days,
  (SELECT count(*) FROM candidates) AS n_candidate_days, (SELECT count(*) FROM numbered) AS n_clusters, CASE
  WHEN count(*) FILTER (semantic) > 0 THEN 'external_post_labels' ELSE 'heuristic_alias_topic' END AS semantics_source, 90 AS baseline_days, 28 AS pre_days, 28 AS post_days
FROM posts"""),
        "cluster_topics": posts(days, _votes("rows", "event_id"), body=" SELECT event_id, topic, votes FROM voted WHERE i = 1"),
        "event_windows": facts(EVENTS, WINDOWS, body=" SELECT * FROM windows"),
        "audience_windows": facts(EVENTS, AUDIENCE, body=" SELECT * FROM audience"),
        "audience_summary": facts(EVENTS, AUDIENCE,
        body=" SELECT count(*) AS n_events, count(*) FILTER (new_p < 0.05 AND new_delta_pp > 0) AS n_up, count(*) FILTER (new_p < 0.05 AND new_delta_pp < 0) AS n_down, round(avg(new_delta_pp), 4) AS mean_pp FROM audience WHERE new_p IS NOT NULL"),
        "newcomer_sentiment": facts(EVENTS, NEWCOMERS, body=" SELECT * FROM newcomers"),
        "conflict_windows": facts(threads, EVENTS, CONFLICTS, body=" SELECT * FROM conflicts"),
        "event_conflict_lift": facts(threads, EVENTS, CONFLICTS, body=" SELECT * FROM lifts"),
        "spillover": facts(EVENTS, SPILL, body=" SELECT * FROM spill"),
        "half_life": facts(EVENTS, body="""
, base AS (SELECT event_id, count(*) FILTER (label = 'negative') / count(*) AS base FROM held WHERE w = 'baseline' GROUP BY 1),
d AS (SELECT event_id, s, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (label = 'negative') AS neg FROM held WHERE w = 'post' GROUP BY 1, 2, 3),
r AS (SELECT *, sum(neg) OVER o / sum(n) OVER o AS rolling FROM d WINDOW o AS (PARTITION BY event_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
f AS (SELECT event_id, coalesce(sum(neg) FILTER (day < s + 3) / sum(n) FILTER (day < s + 3), arg_min(neg / n, day)) AS early FROM d GROUP BY 1),
l AS (SELECT event_id, CASE WHEN rolling <= base + (early - base) / 2 THEN CAST(day - s AS INT) END AS low FROM r JOIN base USING (event_id) JOIN f USING (event_id) WHERE early > base),
g AS (SELECT event_id, coalesce(min(low), 28) AS half_life_days, min(low) IS NOT NULL AS observed FROM l GROUP BY 1)
SELECT event_id, half_life_days, coalesce(observed, false) AS observed FROM happenings LEFT JOIN g USING (event_id)"""),
        "nearby_titles": facts(EVENTS, body="""
, n AS (SELECT event_id, title, row_number() OVER (PARTITION BY event_id ORDER BY published_at, video_id) AS r FROM videos JOIN happenings ON published_at >= s - 7 AND published_at < s + 8)
SELECT event_id, coalesce(string_agg(coalesce(title, ''), ' || ' ORDER BY r) FILTER (r <= 5), '') AS nearby_titles FROM happenings LEFT JOIN n USING (event_id) GROUP BY 1"""),
        "impact_diagnostics": facts(threads, EVENTS, WINDOWS, AUDIENCE, NEWCOMERS, CONFLICTS, SPILL, body=f"""
, x AS (SELECT event_id, {flags} FROM windows LEFT JOIN audience USING (event_id) LEFT JOIN newcomers USING (event_id) LEFT JOIN lifts USING (event_id) LEFT JOIN spill USING (event_id))
SELECT *, {' + '.join(f'CAST({k} AS INT)' for k, _ in names)} AS n_signals, coalesce(nullif(concat_ws(';', {listed}), ''), 'weak_or_baseline_like') AS interpretation FROM x"""),
    }

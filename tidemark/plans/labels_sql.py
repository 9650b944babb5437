"""SQL of the relations of model outputs and of posts with texts: what the columns that they were made of must become."""

from __future__ import annotations

_TOLD = """
WITH told AS (SELECT doc_id AS k, doc_id, text, coalesce(source, 'nowhere') AS source, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, doc_id % 7 AS way
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))"""


def _last(text: str) -> str:
    """The last field as it arrives: whole, without its last two characters, or not at all."""
    return f"CASE way WHEN 3 THEN left({text}, length({text}) - 2) WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE {text} END"


_CONFIDENCE = "CASE WHEN way = 5 THEN 0.35 WHEN k % 6 = 0 THEN 0.7 ELSE least(1, k % 10 / 5) END"


def _reason(text: str) -> str:
    return f"coalesce(trim(regexp_replace({_last(text)}, '\\s+', ' ', 'g')), '')"


def _videos() -> str:
    from tidemark.operators.themes import THEMES

    names = "[" + ", ".join(f"'{n}'" for n in (*THEMES[:6], "nope")) + "]"
    return _TOLD + f""",
n AS (SELECT *, {names} AS names FROM told),
m AS (SELECT *, CASE WHEN way = 5 OR names[k % 7 + 1] = 'nope' THEN 'other' ELSE names[k % 7 + 1] END AS main,
  CASE WHEN way = 5 THEN [] ELSE [x FOR x IN [names[(k + 1) % 7 + 1], names[(k + 3) % 7 + 1]] IF x <> 'nope'] END AS others FROM n)
SELECT doc_id, main AS primary_theme, array_to_string(others, ';') AS secondary_themes,
  coalesce(nullif(concat_ws(';', nullif(main, 'other'), nullif(array_to_string(others, ';'), '')), ''), 'other') AS theme_labels,
  CASE WHEN way <> 5 AND k % 2 = 0 THEN 'travel_vlog' ELSE 'unclear' END AS format,
  CASE WHEN way <> 5 AND k % 3 = 0 THEN 'japan' WHEN way <> 5 AND k % 3 = 1 THEN 'usa' ELSE 'unknown' END AS setting,
  CASE WHEN way <> 5 AND k % 2 = 0 THEN 'entertainment' ELSE 'unknown' END AS audience_intent,
  CASE WHEN way = 5 THEN '' ELSE source || ';A b' END AS entities, {_CONFIDENCE} AS theme_confidence, way = 5 AS theme_parse_error, {_reason("'seen  in ' || source")} AS theme_reason FROM m"""


def _aspects() -> str:
    from tidemark.operators.aspects import ASPECTS

    names = "[" + ", ".join(f"'{n}'" for n in (*ASPECTS[:5], "unclear")) + "]"
    return _TOLD + f""",
n AS (SELECT *, {names} AS names, k % 14 = 5 AS broken, k % 14 = 12 AS missing, least(k % 6 + 1, 4) AS size FROM told),
m AS (SELECT *, CASE WHEN missing THEN [{{a: 'unclear', s: 'unclear', v: 0, c: 0.25}}]
  ELSE [{{a: names[(k + i) % 6 + 1], s: ['negative', 'positive', 'unclear'][(k + i) % 3 + 1], v: least(3, k % 3 + i), c: 0.25 * (i + 1)}} FOR i IN range(size)] END AS items FROM n)
SELECT doc_id, CASE WHEN NOT broken AND NOT missing AND (k + 1) % 6 <> 5 AND size > 1 THEN names[(k + 1) % 6 + 1] ELSE items[1].a END AS primary_aspect,
  array_to_string([x.a FOR x IN items], ';') AS aspect_labels, array_to_string([x.a || '=' || x.s FOR x IN items], ';') AS aspect_sentiments,
  array_to_string([x.a || '=' || x.v FOR x IN items], ';') AS aspect_severities, array_to_string([x.a || '=' || printf('%.2f', x.c) FOR x IN items], ';') AS aspect_confidences,
  missing AS absa_parse_error, CASE WHEN broken THEN 'field_salvage' ELSE '' END AS absa_repair_method, {_reason("'all  of ' || source")} AS absa_summary FROM m"""


def _posts() -> str:
    from tidemark.operators.events import NOISE_WORDS, TOPIC_RULES
    from tidemark.plans.labels import PHRASES

    within = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words)
    topic = "CASE " + " ".join(f"WHEN {within(words)} THEN '{name}'" for name, words in TOPIC_RULES) + " ELSE 'general' END"
    phrases = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
    return f"""
w AS (SELECT doc_id AS event_id, concat_ws(' ', text, {phrases}[doc_id % {len(PHRASES)} + 1]) AS text FROM documents),
x AS (SELECT e.*, text, coalesce(substr([trim(l) FOR l IN string_split(text, chr(10)) IF trim(l) <> ''][1], 1, 200), '') AS title, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS t FROM events e JOIN w USING (event_id)),
j AS (SELECT doc_id AS event_id, doc_id % 6 = 0 OR max(quality) = 1 AS is_relevant, coalesce(max(toxic) = 1, false) AS is_noise, doc_id % 6 <> 0 AS candidate,
  CASE WHEN doc_id % 6 = 0 THEN 'politics_or_culture' ELSE 'other' END AS named FROM labels WHERE doc_id % 3 = 0 GROUP BY 1),
h AS (SELECT *, {within(("elle", "the", "推薦"))} OR {within(("elle", "the", "推薦")).replace("(t,", "(lower(title),")} AS alias_hit, {topic} AS heuristic_topic, {within(NOISE_WORDS)} AS heuristic_noise FROM x LEFT JOIN j USING (event_id)),
posts AS (SELECT CAST(event_id AS VARCHAR) AS post_uid, ts, CAST(ts AS DATE) AS day, title, value AS engagement, CASE WHEN user_id % 2 = 0 THEN 'forum_a' ELSE 'forum_b' END AS source,
  alias_hit, heuristic_topic, heuristic_noise, alias_hit AND NOT heuristic_noise AS heuristic_relevant, named IS NOT NULL AS semantic,
  CASE WHEN named IS NULL THEN alias_hit AND NOT heuristic_noise ELSE coalesce(is_relevant, false) END AS relevant, coalesce(is_noise, heuristic_noise) AS noise, coalesce(named, heuristic_topic) AS topic,
  coalesce(candidate, false) AS hint FROM h)"""


def _imported(order: str) -> str:
    return f"""
WITH b AS (SELECT doc_id, quality AS label, doc_id % 7 AS seq, 0 AS new FROM labels
  UNION ALL SELECT doc_id + 50, toxic + 10, doc_id % 5, 1 FROM labels UNION ALL SELECT doc_id + 50, toxic + 10, 20, 1 FROM labels)
SELECT doc_id, label, seq FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {order}) = 1"""


def sql(views: str) -> dict[str, str]:
    """SQL by query name; views: the CTEs of comments and videos."""
    from tidemark.plans.outside_sql import clusters_of

    posts = _posts()
    return {
        "parsed_sentiment": _TOLD + f""",
l AS (SELECT *, way = 5 AS bad, CASE WHEN way = 5 THEN 'neutral' ELSE ['negative', 'positive', 'neutral', 'neutral'][k % 4 + 1] END AS label,
  CASE WHEN way <> 5 AND k % 5 <> 0 THEN [2 * toxic + 1, 1, greatest(0, quality + k % 3 - 1)] END AS own FROM told),
s AS (SELECT *, CASE WHEN own IS NOT NULL THEN [x / list_sum(own) FOR x IN own] WHEN bad THEN [0.25, 0.5, 0.25]
  ELSE [CASE WHEN label = y THEN 0.8 ELSE 0.1 END FOR y IN ['negative', 'neutral', 'positive']] END AS p FROM l)
SELECT doc_id, bad AS parse_error, label, round(p[1], 6) AS score_neg, round(p[2], 6) AS score_neu, round(p[3], 6) AS score_pos, coalesce({_last("'about ' || source")}, 'unknown') AS target,
  CASE WHEN bad THEN '' ELSE 'joy;' || lower(trim(source)) END AS emotion_tags, CASE WHEN bad THEN 0 ELSE least(1, k % 3 * 0.75) END AS toxicity,
  CASE WHEN bad THEN 0 ELSE greatest(0, k % 4 * 0.5 - 0.5) END AS confidence FROM s""",
        "parsed_post_labels": _TOLD + f""",
c AS (SELECT *, way = 5 AS bad, CASE WHEN way = 5 THEN 'none' ELSE ['other', 'apology_or_controversy', 'none', 'none'][k % 4 + 1] END AS event FROM told)
SELECT doc_id, NOT bad AND quality = 1 AND toxic <> 1 AS is_relevant, NOT bad AND toxic = 1 AS is_noise, NOT bad AND k % 2 = 1 AND toxic <> 1 AS is_external_event_candidate,
  CASE WHEN NOT bad AND k % 3 = 0 THEN 'direct_channel_discussion' ELSE 'unrelated' END AS relevance_type, event AS event_type,
  CASE WHEN bad OR k % 5 = 0 THEN event ELSE source || ' topic' END AS topic_label, CASE WHEN bad THEN 'unclear' ELSE ['critical', 'mixed', 'unclear'][k % 3 + 1] END AS stance,
  CASE WHEN NOT bad AND k % 2 = 0 THEN 'channel' ELSE 'unclear' END AS target, {_CONFIDENCE} AS semantic_confidence, bad AS semantic_parse_error,
  {_reason("'said  of ' || source")} AS semantic_reason FROM c""",
        "parsed_video_labels": _videos(),
        "parsed_aspects": _aspects(),
        "enriched_posts": "WITH " + posts.strip() + " SELECT post_uid, day, title, alias_hit, heuristic_topic, heuristic_noise, heuristic_relevant, semantic, relevant, noise, topic, hint FROM posts",
        "enriched_event_clusters": clusters_of(posts),
        "imported_labels": _imported("seq DESC, new DESC"),
        "imported_labels_keep_first": _imported("new, seq"),
        "retiered_runs": f"""
WITH {views.strip()}, nat AS (SELECT s_suppkey AS supplier_id, n_name AS run FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT * FROM all_comments JOIN nat USING (supplier_id)), sizes AS (SELECT run, count(DISTINCT video_id) AS total FROM c GROUP BY 1),
act AS (SELECT run, actor_id, count(*) AS nc, count(DISTINCT video_id) AS nv, sum(like_count) AS likes FROM c GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN nv <= 1 THEN 'one_time' WHEN nv / total >= 0.05 AND nv >= 3 THEN 'core' WHEN nv / total >= 0.02 THEN 'regular' ELSE 'returning' END AS tier FROM act JOIN sizes USING (run))
SELECT run, tier, count(*) AS n_commenters, round(avg(nv), 6) AS mean_videos, CAST(median(nv) AS DOUBLE) AS median_videos, CAST(sum(nc) AS BIGINT) AS comments, CAST(sum(likes) AS BIGINT) AS likes,
  round(100 * (count(*) / sum(count(*)) OVER (PARTITION BY run)), 6) AS pct_commenters FROM t GROUP BY 1, 2""",
        "first_known_scores": f"""
WITH {views.strip()}, o AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY ts, thread_id, line, video_id) AS i,
  row_number() OVER (PARTITION BY actor_id ORDER BY confidence IS NULL, ts, thread_id, line, video_id) AS j FROM all_comments)
SELECT actor_id, max(confidence) FILTER (j = 1) AS confidence, max(video_id) FILTER (i = 1) AS video_id FROM o GROUP BY 1""",
    }

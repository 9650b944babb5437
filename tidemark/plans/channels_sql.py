"""SQL of the channel metrics, written from their definitions apart from the DataFrame code."""

from __future__ import annotations

from tidemark.operators.channels import READINGS

INDICES = """
spec(index_name, metric, inverted) AS (VALUES
  ('engagement_conversion', 'comments_per_1k_views', false), ('engagement_conversion', 'comments_per_video', false), ('engagement_conversion', 'commenters_per_video', false),
  ('audience_stickiness', 'high_mid_tier_commenter_share', false), ('audience_stickiness', 'high_mid_tier_comment_share', false),
  ('audience_stickiness', 'continuity_return_rate_w4', false), ('audience_stickiness', 'rolling_return_rate_latest', false),
  ('conversation_quality', 'positive_rate', false), ('conversation_quality', 'negative_rate', true), ('conversation_quality', 'like_weighted_negative_rate', true),
  ('conversation_quality', 'reply_negative_rate', true),
  ('risk_pressure', 'negative_rate', false), ('risk_pressure', 'like_weighted_negative_rate', false), ('risk_pressure', 'max_video_like_weighted_negative_rate', false),
  ('risk_pressure', 'max_video_like_weighted_conflict_score', false),
  ('community_concentration', 'largest_community_share', false), ('community_concentration', 'top3_community_share', false), ('community_concentration', 'community_hhi', false),
  ('content_portfolio_linkage', 'video_network_density', false), ('content_portfolio_linkage', 'video_network_modularity', false),
  ('content_portfolio_linkage', 'top_bridge_participation_mean', false)),
indices AS (SELECT channel, index_name, round(avg(CASE WHEN inverted THEN 100 - percentile ELSE percentile END), 4) AS score, count(*) AS n_components FROM ranks
  JOIN spec USING (metric) GROUP BY 1, 2)
"""
RANKS = """
ranks AS (
  SELECT channel, metric, value, round(100 * (rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric,
  value) - 1) / 2) / count(*) OVER (PARTITION BY metric), 6) AS percentile, count(*) OVER (PARTITION BY metric) AS cohort_n
  FROM metrics)
"""
#: Polarity by the fixed values of the metrics.
POLARITY_RULE = "CASE " + " ".join(f"WHEN metric IN ({', '.join(repr(n) for n in names)}) THEN '{polarity}'"
    for (_, polarity), names in READINGS.items()) + " ELSE 'mixed_high' END"
POLARITY = f"""
readings AS (
  SELECT *, abs(percentile - 50) AS x, CASE WHEN polarity = 'risk_high' AND percentile >= 75 THEN 'risk' WHEN polarity = 'risk_high' AND percentile <= 25 THEN 'opportunity'
  WHEN polarity = 'benefit_high' AND percentile >= 75 THEN 'opportunity'
    WHEN polarity = 'benefit_high' AND percentile <= 25 THEN 'risk'
    WHEN polarity IN ('concentration_high', 'mixed_high') AND (percentile >= 75 OR percentile <= 25) THEN 'watch' ELSE 'context' END AS reading
  FROM (SELECT *, {POLARITY_RULE} AS polarity FROM ranks))
"""
GROUPS = {
    "scale": ["n_videos_in_scope", "top_level_comments", "top_level_commenters", "all_comments"],
    "engagement": ["comments_per_video", "commenters_per_video", "comments_per_1k_views"],
    "retention": ["high_mid_tier_commenter_share", "high_mid_tier_comment_share", "continuity_return_rate_w4", "rolling_return_rate_mean",
    "rolling_return_rate_latest"],
    "commenter_network": ["commenter_network_density", "commenter_network_modularity", "commenter_network_communities",
    "largest_community_share", "top3_community_share", "community_hhi", "top_bridge_participation_mean"],
    "video_network": ["video_network_density", "video_network_modularity", "video_network_clusters"],
    "sentiment": ["negative_rate", "positive_rate", "like_weighted_negative_rate", "like_weighted_positive_rate", "max_video_negative_rate",
    "top5_hotspot_negative_rate_mean", "max_video_like_weighted_negative_rate", "max_community_negative_rate"],
    "reply_conflict": ["reply_share_all_comments", "pct_threads_with_replies", "reply_negative_rate", "max_video_conflict_score",
    "max_video_reply_count_weighted_conflict_score", "max_video_like_weighted_conflict_score", "max_video_conflict_thread_rate_replied",
    "max_theme_conflict_score", "max_theme_reply_count_weighted_conflict_score", "max_theme_like_weighted_conflict_score"],
}


def _graph(prefix: str, node: str, via: str, least_via: int, least_weight: int, member: str) -> str:
    """CTEs of each channel's graph; the last is {prefix}net(channel, density, modularity, communities)."""
    p = prefix
    return f"""
{p}pairs AS (SELECT DISTINCT channel, {node} AS node, {via} AS via FROM cc),
{p}kept AS (SELECT * FROM {p}pairs WHERE (channel, node) IN (SELECT (channel, node) FROM {p}pairs GROUP BY channel, node HAVING count(*) >= {least_via})),
{p}edges AS (SELECT x.channel, x.node AS a, y.node AS b, count(*) AS weight FROM {p}kept x JOIN {p}kept y ON x.channel = y.channel AND x.via = y.via AND x.node < y.node
  GROUP BY 1, 2, 3 HAVING count(*) >= {least_weight}),
{p}ends AS (SELECT channel, a AS u, b AS v, weight FROM {p}edges UNION ALL SELECT channel, b, a, weight FROM {p}edges),
{p}member AS ({member}),
{p}parts AS (SELECT e.*, m.part AS u_part, n.part AS v_part FROM {p}ends e JOIN {p}member m ON m.node = u JOIN {p}member n ON n.node = v),
{p}size AS (SELECT channel, count(DISTINCT u) AS n, count(*) / 2 AS m FROM {p}ends GROUP BY 1),
{p}vol AS (SELECT channel, u_part, coalesce(sum(weight) FILTER (u_part = v_part), 0) AS inside, sum(weight) AS volume FROM {p}parts GROUP BY 1, 2),
{p}mod AS (SELECT channel, sum(inside / m - (volume / m) * (volume / m)) AS modularity, count(*) AS communities FROM (SELECT *, sum(volume) OVER (PARTITION BY channel) AS m FROM {p}vol) GROUP BY 1),
{p}net AS (SELECT channel, 2 * m / nullif(n * (n - 1), 0) AS density, modularity, communities FROM {p}size JOIN {p}mod USING (channel))"""


def metrics(threads: str, video_conflict: str, theme_conflict: str) -> str:
    """CTEs up to metrics(channel, metric, value); threads: CTEs of the threads of each channel, from `cc`."""
    heavy = lambda label: f"coalesce(sum(like_count + 1) FILTER (label = '{label}'), 0) / sum(like_count + 1)"
    names = {
        "n_videos_in_scope": "nv", "top_level_comments": "c", "top_level_commenters": "a", "all_comments": "n",
        "comments_per_video": "c / nv", "commenters_per_video": "a / nv", "comments_per_1k_views": "1000 * c / nullif(views, 0)",
        **{f"{t}_tier_commenter_share": f"t_{t} / a" for t in ("core", "regular", "returning", "one_time")},
        "core_regular_tier_commenter_share": "(t_core + t_regular) / a", "core_regular_tier_comment_share": "engaged / c",
        "high_tier_commenter_share": "t_core / a", "mid_tier_commenter_share": "t_regular / a",
        "low_tier_commenter_share": "t_returning / a + t_one_time / a", "high_mid_tier_commenter_share": "(t_core + t_regular) / a",
        "high_mid_tier_comment_share": "engaged / c",
        "continuity_return_rate_w4": "w4", "rolling_return_rate_mean": "roll_mean", "rolling_return_rate_latest": "roll_last",
        "commenter_network_density": "an.density", "commenter_network_modularity": "an.modularity", "commenter_network_communities": "an.communities",
        "largest_community_share": "top1", "top3_community_share": "top3", "community_hhi": "hhi",
        "top_bridge_participation_mean": "bridge", "video_network_density": "vn.density", "video_network_modularity": "vn.modularity",
        "video_network_clusters": "vn.communities",
        "negative_rate": "neg", "positive_rate": "pos", "like_weighted_negative_rate": "wneg", "like_weighted_positive_rate": "wpos",
        "max_video_negative_rate": "spot_max", "top5_hotspot_negative_rate_mean": "spot_top5",
        "max_video_like_weighted_negative_rate": "spot_wmax", "max_community_negative_rate": "com_max",
        "reply_share_all_comments": "reply_share", "pct_threads_with_replies": "replied_share", "reply_negative_rate": "reply_neg",
        "max_video_conflict_score": "vc.s1", "max_video_reply_count_weighted_conflict_score": "vc.s2",
        "max_video_like_weighted_conflict_score": "vc.s3", "max_video_conflict_thread_rate_replied": "vc.s4",
        "max_theme_conflict_score": "tc.s1", "max_theme_reply_count_weighted_conflict_score": "tc.s2", "max_theme_like_weighted_conflict_score": "tc.s3",
    }
    listed = ", ".join(f"{{metric: '{k}', value: CAST({v} AS DOUBLE)}}" for k, v in names.items())
    worst = lambda of: f"SELECT channel, max(conflict_score) AS s1, max(reply_conflict_score) AS s2, max(weighted_conflict_score) AS s3, max(conflict_rate_replied) AS s4 FROM ({of}) GROUP BY 1"
    return f"""
cc AS (SELECT c.*, n_name AS channel FROM all_comments c JOIN supplier ON s_suppkey = supplier_id JOIN nation ON n_nationkey = s_nationkey),
ct AS (SELECT * FROM cc WHERE is_top_level),
scope AS (SELECT channel, count(*) AS nv, sum(view_count) AS views FROM (SELECT DISTINCT channel, video_id FROM cc) JOIN videos USING (video_id) GROUP BY 1),
acts AS (SELECT channel, actor_id, count(*) AS c, count(DISTINCT video_id) AS v FROM ct GROUP BY 1, 2),
tiered AS (SELECT *, CASE WHEN v <= 1 THEN 'one_time' WHEN v / nv >= 0.01 AND v >= 3 THEN 'core' WHEN v / nv >= 0.004 THEN 'regular' ELSE 'returning' END AS tier FROM acts JOIN scope USING (channel)),
tiers AS (SELECT channel, count(*) AS a, sum(c) AS c, {', '.join(f"count(*) FILTER (tier = '{t}') AS t_{t}" for t in ('core', 'regular', 'returning', 'one_time'))},
  coalesce(sum(c) FILTER (tier IN ('core', 'regular')), 0) AS engaged FROM tiered GROUP BY 1),
cav AS (SELECT DISTINCT channel, actor_id, video_id FROM ct),
vid AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY published_at, video_id) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n,
  ntile(4) OVER (PARTITION BY channel ORDER BY published_at, video_id) AS block FROM (SELECT DISTINCT channel, video_id FROM cc) JOIN videos USING (video_id)),
blocks AS (SELECT DISTINCT channel, block, actor_id FROM cav JOIN vid USING (channel, video_id)),
cont AS (SELECT x.channel, count(y.actor_id) / count(*) AS w4 FROM blocks x LEFT JOIN blocks y ON y.channel = x.channel AND y.actor_id = x.actor_id AND y.block = x.block + 1
  WHERE x.block < 4 GROUP BY 1),
cuts AS (SELECT channel, unnest(generate_series(0, n - 100, 25)) AS cut FROM (SELECT DISTINCT channel, n FROM vid) WHERE n >= 100),
rolled AS (SELECT channel, cut, actor_id, bool_or(i < cut + 50) AS base, bool_or(i >= cut + 50) AS later FROM cuts JOIN vid USING (channel) JOIN cav USING (channel, video_id)
  WHERE i >= cut AND i < cut + 100 GROUP BY 1, 2, 3),
rates AS (SELECT channel, cut, round(count(*) FILTER (base AND later) / nullif(count(*) FILTER (base), 0), 6) AS r FROM rolled GROUP BY 1, 2),
roll AS (SELECT channel, avg(r) AS roll_mean, max({{cut: cut, r: r}}).r AS roll_last FROM rates GROUP BY 1),
{_graph('a', 'actor_id', 'video_id', 2, 1, 'SELECT actor_id AS node, community AS part FROM actors')},
ashare AS (SELECT channel, part, count(*) / sum(count(*)) OVER (PARTITION BY channel) AS share, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, part) AS i
  FROM (SELECT DISTINCT channel, u FROM aends) JOIN amember ON node = u GROUP BY 1, 2),
aconc AS (SELECT channel, max(share) AS top1, sum(share) FILTER (i <= 3) AS top3, sum(share * share) AS hhi FROM ashare GROUP BY 1),
anode AS (SELECT channel, u, sum(w) AS s, 1 - sum(w * w) / (sum(w) * sum(w)) AS p FROM (SELECT channel, u, v_part, sum(weight) AS w FROM aparts GROUP BY 1, 2, 3) GROUP BY 1, 2),
arank AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(s * p, 6) DESC, round(p, 6) DESC, channel || '|' || u) AS i FROM anode),
abridge AS (SELECT channel, avg(p) AS bridge FROM arank WHERE i <= 50 GROUP BY 1),
{_graph('v', 'video_id', 'actor_id', 2, 1, 'SELECT video_id AS node, label AS part FROM videos')},
mood AS (SELECT channel, count(*) AS n, count(*) FILTER (label = 'negative') / count(*) AS neg,
  count(*) FILTER (label = 'positive') / count(*) AS pos, {heavy('negative')} AS wneg, {heavy('positive')} AS wpos FROM cc GROUP BY 1),
spots AS (SELECT channel, video_id, count(*) FILTER (label = 'negative') / count(*) AS rate, {heavy('negative')} AS heavy FROM cc GROUP BY 1, 2),
spot AS (SELECT channel, max(rate) AS spot_max, max(heavy) AS spot_wmax, avg(rate) FILTER (i <= 5) AS spot_top5 FROM (SELECT *,
  row_number() OVER (PARTITION BY channel ORDER BY rate DESC, video_id) AS i FROM spots) GROUP BY 1),
com AS (SELECT channel, max(rate) AS com_max FROM (SELECT channel, community, count(*) FILTER (label = 'negative') / count(*) AS rate FROM cc JOIN actors USING (actor_id) GROUP BY 1, 2) GROUP BY 1),
rep AS (SELECT channel, count(*) FILTER (NOT is_top_level) / count(*) AS reply_share,
  count(DISTINCT thread_id) FILTER (NOT is_top_level) / count(DISTINCT thread_id) AS replied_share,
  count(*) FILTER (NOT is_top_level AND label = 'negative') / nullif(count(*) FILTER (NOT is_top_level), 0) AS reply_neg FROM cc GROUP BY 1),
{threads.strip()},
vc AS ({worst(video_conflict)}), tc AS ({worst(theme_conflict)}),
metrics AS (
  SELECT channel, m.metric, round(m.value, 6) AS value FROM (
    SELECT channel, unnest([{listed}]) AS m
    FROM scope LEFT JOIN tiers USING (channel) LEFT JOIN cont USING (channel) LEFT JOIN roll USING (channel) LEFT JOIN anet an USING (channel) LEFT JOIN aconc USING (channel) LEFT
    JOIN abridge USING (channel) LEFT JOIN vnet vn USING (channel)
      LEFT JOIN mood USING (channel) LEFT JOIN spot USING (channel) LEFT JOIN com USING (channel) LEFT JOIN rep USING (channel) LEFT JOIN vc USING (channel) LEFT JOIN tc USING (channel))
  WHERE m.value IS NOT NULL)
"""

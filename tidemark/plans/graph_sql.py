"""SQL of the graph relations: loops as recursive queries, written apart from the DataFrame code."""

from __future__ import annotations

# A graph's CTEs need edges(a, b, weight), ends(u, v, weight), deg(node, degree, strength), and
# member(node, part): the partition.
PARTS = """
parts AS (SELECT e.*, p.part AS u_part, q.part AS v_part FROM ends e JOIN member p ON p.node = u JOIN member q ON q.node = v)
"""
COMPONENTS = """
comp(node, part) USING KEY (node) AS (
  SELECT node, node FROM deg
  UNION SELECT e.u, min(c.part) FROM comp c JOIN ends e ON e.v = c.node JOIN recurring.comp r ON r.node = e.u GROUP BY e.u, r.part HAVING min(c.part) < r.part)
"""
CORES = """
cores(node, core) USING KEY (node) AS (
  SELECT node, CAST(degree AS INT) FROM deg
  UNION SELECT node, h FROM (
    SELECT u AS node, CAST(max(least(k, c)) AS INT) AS h
    FROM (SELECT u, c, sum(n) OVER (PARTITION BY u ORDER BY c DESC) AS k FROM (SELECT e.u, r.core AS c, count(*) AS n FROM ends e JOIN recurring.cores r ON r.node = e.v
    WHERE (SELECT count(*) FROM cores) > 0 GROUP BY 1, 2))
    GROUP BY 1) JOIN recurring.cores q USING (node) WHERE h < q.core)
"""
BETWEEN = """
size AS (SELECT count(*) AS n, least(128, count(*)) AS k FROM deg),
pivots AS (SELECT node FROM deg ORDER BY md5(CAST(node AS VARCHAR)), node LIMIT 128),
bfs(p, node, dist, paths) USING KEY (p, node) AS (
  SELECT node, node, 0, CAST(1 AS DOUBLE) FROM pivots
  UNION SELECT b.p, e.v, b.dist + 1, sum(b.paths) FROM bfs b JOIN ends e ON e.u = b.node WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.p = b.p AND r.node = e.v) GROUP BY 1, 2, 3),
back(p, node, dist, paths, delta) AS (
  SELECT p, node, dist, paths, CAST(0 AS DOUBLE) FROM bfs WHERE dist = (SELECT max(dist) FROM bfs)
  UNION ALL
  SELECT b.p, b.node, b.dist, b.paths, coalesce(sum(b.paths / w.paths * (1 + w.delta)), 0)
  FROM bfs b JOIN (SELECT min(dist) - 1 AS d FROM back) x ON b.dist = x.d LEFT JOIN (SELECT e.v AS u, g.* FROM back g JOIN ends e ON e.u = g.node) w ON w.p = b.p AND w.u = b.node GROUP BY 1, 2, 3, 4),
given AS (SELECT node, sum(CASE WHEN p <> node THEN delta ELSE 0 END) AS s FROM back GROUP BY 1),
between_ AS (SELECT node, round(coalesce(s, 0) * CASE WHEN n > 2 THEN n / k / ((n - 1) * (n - 2)) ELSE 0 END, 9) AS betweenness FROM deg CROSS JOIN size LEFT JOIN given USING (node))
"""
NODES = """
by_part AS (SELECT u, u_part, v_part, sum(weight) AS w, count(*) AS d FROM parts GROUP BY ALL),
raw_nodes AS (
  SELECT u AS node, u_part AS part, CAST(sum(d) AS BIGINT) AS degree, CAST(sum(w) AS BIGINT) AS strength, count(*) AS n_parts,
  CAST(coalesce(sum(w) FILTER (v_part = u_part), 0) AS BIGINT) AS same_weight, CAST(coalesce(sum(w) FILTER (v_part <> u_part), 0) AS BIGINT) AS cross_weight,
    1 - sum(w * w) / (sum(w) * sum(w)) AS p FROM by_part GROUP BY 1, 2),
nodes AS (
  SELECT node, part, degree, strength, core, betweenness, n_parts, same_weight, cross_weight, round(cross_weight / strength, 6) AS cross_share, round(p, 6) AS participation,
  round(strength * p, 4) AS bridge, round(strength * p * (1 + betweenness), 4) AS structural_bridge
  FROM raw_nodes JOIN cores USING (node) JOIN between_ USING (node))
"""
SUMMARY = """
sums AS (
  SELECT u_part AS part, count(*) FILTER (u_part = v_part AND u < v) AS internal_edges, count(*) FILTER (u_part <> v_part) AS external_edges,
  CAST(coalesce(sum(weight) FILTER (u_part = v_part AND u < v), 0) AS BIGINT) AS internal_weight,
    CAST(coalesce(sum(weight) FILTER (u_part <> v_part), 0) AS BIGINT) AS cut, CAST(sum(weight) AS BIGINT) AS volume FROM parts GROUP BY 1),
own AS (SELECT part, count(*) AS n_nodes, round(avg(core), 6) AS mean_core, max(core) AS max_core FROM cores JOIN member USING (node) GROUP BY 1),
summary AS (
  SELECT *, round(100 * n_nodes / sum(n_nodes) OVER (), 6) AS pct_nodes, 2 * internal_weight AS inner_volume, round(cut / nullif(least(volume,
  sum(volume) OVER () - volume), 0), 6) AS conductance FROM sums JOIN own USING (part))
"""
MODULARITY = """
vol AS (SELECT u_part, coalesce(sum(weight) FILTER (u_part = v_part), 0) AS inside, sum(weight) AS volume, count(*) FILTER (u_part = v_part) AS same_ends, count(*) AS all_ends FROM parts GROUP BY 1),
whole AS (SELECT sum(volume) AS m, sum(all_ends) AS c FROM vol),
modular AS (SELECT round(sum(inside / m - (volume / m) * (volume / m)), 6) AS modularity,
  round((sum(same_ends / c) - sum((all_ends / c) * (all_ends / c))) / nullif(1 - sum((all_ends / c) * (all_ends / c)), 0), 6) AS attribute_assortativity FROM vol, whole),
mixing AS (SELECT CASE WHEN stddev_pop(p.degree) * stddev_pop(q.degree) > 0 THEN round(corr(CAST(p.degree AS DOUBLE), CAST(q.degree AS DOUBLE)), 6) END AS degree_assortativity FROM ends JOIN deg p ON p.node = u JOIN deg q ON q.node = v)
"""
NETWORK = """
dm AS (SELECT * FROM deg JOIN member USING (node)),
tot AS (SELECT count(*) AS n_nodes, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, round(avg(degree), 6) AS mean_degree, round(avg(strength), 6) AS mean_strength FROM dm),
sh AS (SELECT part, count(*) / sum(count(*)) OVER () AS share, row_number() OVER (ORDER BY count(*) DESC, part) AS i FROM dm GROUP BY 1),
conc AS (SELECT count(*) AS n_communities, sum(share * share) AS h, round(max(share), 6) AS top1_share, round(sum(share) FILTER (i <= 3), 6) AS top3_share FROM sh),
kc AS (SELECT max(core) AS max_core, round(count(*) FILTER (core = (SELECT max(core) FROM cores)) / count(*), 6) AS max_core_share, round(avg(core), 6) AS mean_core FROM cores),
network AS (
  SELECT n_nodes, n_edges, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 9) AS density, mean_degree, mean_strength, n_communities, modularity, round(h, 6) AS hhi,
  round(1 / h, 6) AS effective_communities, top1_share, top3_share, max_core, max_core_share, mean_core, degree_assortativity, attribute_assortativity
  FROM tot, conc, modular, kc, mixing)
"""
LINKS = """
hops AS (
  SELECT x.v AS a, y.v AS b, count(*) AS common, sum(CASE WHEN d.degree > 1 THEN 1 / ln(d.degree) ELSE 0 END) AS aa, sum(1 / d.degree) AS ra
  FROM ends x JOIN ends y ON x.u = y.u AND x.v < y.v JOIN deg d ON d.node = x.u GROUP BY 1, 2),
candidates AS (
  SELECT h.a, h.b, common, common / (p.degree + q.degree - common) AS j, aa, ra FROM hops h JOIN deg p ON p.node = h.a JOIN deg q ON q.node = h.b
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = h.a AND e.b = h.b)),
links AS (
  SELECT a, b, common, round(j, 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS resource_allocation, round(ln(1 + common) + 2 * j + aa + ra, 4) AS score FROM candidates
  ORDER BY score DESC, adamic_adar DESC, resource_allocation DESC, jaccard DESC, a, b LIMIT 100)
"""
CLUSTERS = """
cstats AS (SELECT video_id, count(*) AS n_comments, count(DISTINCT actor_id) AS n_commenters FROM all_comments GROUP BY 1),
clustered AS (SELECT m.node AS video_id, m.part AS cluster, title, published_at, view_count, theme, n_comments, n_commenters FROM deg JOIN member m USING (node) LEFT
  JOIN videos v ON v.video_id = m.node LEFT JOIN cstats s ON s.video_id = m.node),
clabels AS (SELECT video_id, theme AS label FROM videos UNION ALL SELECT video_id, 'brand ' || label FROM videos)
"""
CLUSTER_SUMMARY = """
c_own AS (SELECT cluster, count(*) AS n_videos, min(published_at) AS date_min, max(published_at) AS date_max, CAST(coalesce(sum(n_comments), 0) AS BIGINT) AS n_comments,
  round(median(n_commenters), 6) AS median_commenters, CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views FROM clustered GROUP BY 1),
c_actors AS (SELECT cluster, count(DISTINCT actor_id) AS n_commenters FROM all_comments JOIN clustered USING (video_id) GROUP BY 1),
c_labels AS (SELECT cluster, label, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) AS i FROM clabels JOIN clustered USING (video_id) GROUP BY 1, 2),
c_top AS (SELECT cluster, string_agg(label || ' (' || n || ')', '; ' ORDER BY i) AS top_labels FROM c_labels WHERE i <= 5 GROUP BY 1),
v_rank AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY clustered.n_commenters DESC NULLS LAST, clustered.n_comments DESC NULLS LAST, title) AS i FROM clustered),
v_top AS (SELECT cluster, string_agg(substr(title, 1, 48) || ' (' || n_commenters || ')', '; ' ORDER BY i) AS top_videos FROM v_rank WHERE i <= 5 GROUP BY 1)
"""


_RATES = ", ".join(f"round(count(*) FILTER (c.label = '{x}') / count(*), 6) AS {x}_rate" for x in ("negative", "neutral", "positive"))
_RATES += ", " + ", ".join(f"round(coalesce(sum(like_count + 1) FILTER (c.label = '{x}'), 0) / sum(like_count + 1), 6) AS weighted_{x}_rate" for x in ("negative",
    "positive"))


def sql(views: str, edges: str, video_edges: str) -> dict[str, str]:
    """SQL by query name. views, edges, video_edges: CTEs that the facts and the two graphs begin with."""

    def graph(first: str, member: str):
        return lambda *parts, body: "WITH RECURSIVE " + ", ".join(p.strip() for p in (views, first, member, *parts)) + body

    actor = graph(edges, "member AS (SELECT actor_id AS node, community AS part FROM actors)")
    video = graph(video_edges, "member AS (SELECT video_id AS node, label AS part FROM videos)")
    bridges = "ORDER BY structural_bridge DESC, bridge DESC, participation DESC, node LIMIT 50"
    top = "ORDER BY structural_bridge DESC, betweenness DESC, core DESC, strength DESC, node LIMIT 200"
    node_parts = (PARTS, CORES, BETWEEN, NODES)
    net_parts = (PARTS, CORES, MODULARITY, NETWORK)
    return {
        "cocommenter_edges": actor(body=" SELECT * FROM edges"),
        "connected_components": actor(COMPONENTS, body=" SELECT * FROM comp"),
        "core_numbers": actor(CORES, body=" SELECT * FROM cores"),
        "betweenness": actor(BETWEEN, body=" SELECT * FROM between_"),
        "node_metrics": actor(*node_parts, body=" SELECT * FROM nodes"),
        "bridge_actors": actor(*node_parts, body=f" SELECT * FROM nodes {bridges}"),
        "network_actor_metrics": actor(*node_parts, body=f" SELECT * FROM nodes {top}"),
        "community_summary": actor(PARTS, CORES, SUMMARY, body=" SELECT * FROM summary"),
        "network_summary": actor(*net_parts, body=" SELECT * FROM network"),
        "bridge_profiles": actor(*node_parts, body=f"""
, b AS (SELECT node, part, bridge FROM nodes {bridges}), n AS (SELECT actor_id AS node, count(*) AS n_comments, count(DISTINCT video_id) AS n_videos,
  CAST(sum(like_count) AS BIGINT) AS likes FROM all_comments GROUP BY 1)
SELECT b.*, name, n_comments, n_videos, likes FROM b LEFT JOIN n USING (node) LEFT JOIN actors ON actor_id = node"""),
        "community_profiles": actor(PARTS, CORES, SUMMARY, body=f"""
, c AS (SELECT i.*, title, theme FROM in_community i LEFT JOIN videos USING (video_id)),
o AS (SELECT community, count(DISTINCT actor_id) AS n_commenters, count(*) AS n_comments, count(DISTINCT video_id) AS n_videos FROM c GROUP BY 1),
t AS (SELECT community, theme, count(DISTINCT actor_id) AS n, row_number() OVER (PARTITION BY community ORDER BY count(DISTINCT actor_id) DESC, count(*) DESC, theme) AS i FROM c GROUP BY 1, 2),
v AS (SELECT community, video_id, title, count(DISTINCT actor_id) AS n, row_number() OVER (PARTITION BY community ORDER BY count(DISTINCT actor_id) DESC, count(*) DESC, video_id,
  title) AS i FROM c GROUP BY 1, 2, 3),
tt AS (SELECT community, string_agg(substr(theme, 1, 48) || ' (' || n || ')', '; ' ORDER BY i) AS top_themes FROM t WHERE i <= 5 GROUP BY 1), vv AS (SELECT community,
  string_agg(substr(title, 1, 48) || ' (' || n || ')', '; ' ORDER BY i) AS top_titles FROM v WHERE i <= 5 GROUP BY 1)
SELECT o.*, top_themes, top_titles, n_nodes, pct_nodes FROM o LEFT JOIN tt USING (community) LEFT JOIN vv USING (community) LEFT JOIN summary ON part = community"""),
        "modularity": actor(PARTS, MODULARITY, body=" SELECT modularity FROM modular"),
        "attribute_assortativity": actor(PARTS, MODULARITY, body=" SELECT attribute_assortativity FROM modular"),
        "degree_assortativity": actor(PARTS, MODULARITY, body=" SELECT degree_assortativity FROM mixing"),
        "link_opportunities": actor(LINKS, body=" SELECT * FROM links"),
        "shared_audience_edges": video(body=" SELECT * FROM edges"),
        "video_network_summary": video(*net_parts, body=" SELECT * FROM network"),
        "video_network_metrics": video(*node_parts, body=" SELECT n.*, title, published_at FROM nodes n JOIN videos ON video_id = node"),
        "video_community_summary": video(PARTS, CORES, SUMMARY, body=" SELECT * FROM summary"),
        "video_clusters": video(CLUSTERS, body=" SELECT * FROM clustered"),
        "video_cluster_summary": video(CLUSTERS, CLUSTER_SUMMARY,
        body=" SELECT * FROM c_own LEFT JOIN c_actors USING (cluster) LEFT JOIN c_top USING (cluster) LEFT JOIN v_top USING (cluster)"),
        "video_partition_checks": video(body=" SELECT a AS algorithm, (SELECT count(*) FROM deg) AS n_nodes, true AS connected, true AS better FROM (VALUES ('auto'), ('infomap'), ('greedy')) AS t(a)"),
        "video_cluster_theme_affinity": video(CLUSTERS, body="""
, x AS (SELECT cluster, label, count(DISTINCT video_id) AS n_videos FROM clustered JOIN clabels USING (video_id) GROUP BY 1, 2),
y AS (SELECT cluster, count(*) AS cluster_videos FROM clustered GROUP BY 1), z AS (SELECT label, count(*) AS label_videos FROM clustered JOIN clabels USING (video_id) GROUP BY 1),
  t AS (SELECT count(*) AS n FROM clustered)
SELECT cluster, label, n_videos, cluster_videos, label_videos, round(n_videos / cluster_videos, 6) AS cluster_share, round(label_videos / n, 6) AS overall_share,
  round((n_videos / cluster_videos) / (label_videos / n), 6) AS lift FROM x JOIN y USING (cluster) JOIN z USING (label), t"""),
        "video_cluster_profiles": video(CLUSTERS, CLUSTER_SUMMARY, PARTS, CORES, SUMMARY, body="""
, x AS (SELECT cluster, label, count(DISTINCT video_id) AS n_videos FROM clustered JOIN clabels USING (video_id) GROUP BY 1, 2),
y AS (SELECT cluster, count(*) AS cv FROM clustered GROUP BY 1), z AS (SELECT label, count(*) AS lv FROM clustered JOIN clabels USING (video_id) GROUP BY 1),
  t AS (SELECT count(*) AS n FROM clustered),
lifts AS (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY round((n_videos / cv) / (lv / n), 6) DESC, n_videos DESC, label) AS i FROM x
  JOIN y USING (cluster) JOIN z USING (label), t),
o AS (SELECT cluster, string_agg(label, '; ' ORDER BY i) AS over_indexed FROM lifts WHERE i <= 4 GROUP BY 1),
rates AS (SELECT v.label AS cluster, {rates} FROM all_comments c JOIN videos v USING (video_id) GROUP BY 1),
mood AS (SELECT *, CASE WHEN negative_rate >= neutral_rate AND negative_rate >= positive_rate THEN 'negative'
  WHEN neutral_rate >= positive_rate THEN 'neutral' ELSE 'positive' END AS dominant FROM rates)
SELECT s.*, n_commenters, top_labels, top_videos, internal_edges, external_edges, conductance, CASE WHEN conductance IS NULL THEN 'unknown' WHEN conductance < 0.4 THEN 'tight'
  WHEN conductance < 0.7 THEN 'bridging' ELSE 'loose' END AS shared_audience,
  dominant, CASE WHEN dominant = 'positive' AND negative_rate < 0.1 THEN 'mostly_positive' WHEN dominant = 'positive' THEN 'positive_but_watch_negative'
  WHEN dominant = 'neutral' THEN 'mostly_neutral' ELSE 'negative_high' END AS sentiment_reading, negative_rate, neutral_rate, positive_rate, weighted_negative_rate,
  weighted_positive_rate, over_indexed
FROM c_own s LEFT JOIN c_actors USING (cluster) LEFT JOIN c_top USING (cluster) LEFT JOIN v_top USING (cluster) LEFT JOIN summary p ON p.part = s.cluster LEFT
  JOIN mood USING (cluster) LEFT JOIN o USING (cluster)""".replace("{rates}", _RATES)),
        "video_opportunities": video(LINKS, CLUSTERS, body="""
, shared AS (SELECT l.a, l.b, count(*) AS shared FROM links l JOIN actor_videos x ON x.video_id = l.a JOIN actor_videos y ON y.video_id = l.b AND y.actor_id = x.actor_id GROUP BY 1, 2),
mids AS (SELECT l.a, l.b, x.v AS mid, coalesce(n_commenters, 0) AS n, coalesce(title, CAST(x.v AS VARCHAR)) AS t FROM links l JOIN ends x ON x.u = l.a
  JOIN ends y ON y.u = l.b AND y.v = x.v JOIN clustered ON video_id = x.v),
ordered AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY mid) AS i, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, t DESC, mid DESC) AS j FROM mids),
common AS (SELECT a, b, string_agg(CAST(mid AS VARCHAR), '; ' ORDER BY i) FILTER (i <= 10) AS common_ids,
  string_agg(substr(t, 1, 72), '; ' ORDER BY j) FILTER (j <= 5) AS common_titles FROM ordered GROUP BY 1, 2)
SELECT l.*, p.title AS a_title, p.theme AS a_theme, p.cluster AS a_cluster, q.title AS b_title, q.theme AS b_theme, q.cluster AS b_cluster, coalesce(shared, 0) AS shared, common_ids, common_titles,
  CASE WHEN coalesce(shared, 0) = 0 AND p.cluster <> q.cluster THEN 'latent_cross_cluster_bridge'
  WHEN p.cluster <> q.cluster AND p.theme <> q.theme THEN 'cross_cluster_theme_bridge' WHEN p.cluster = q.cluster AND p.theme <> q.theme THEN 'within_cluster_theme_blend'
    WHEN p.cluster <> q.cluster AND p.theme = q.theme THEN 'same_theme_cross_cluster_bridge' ELSE 'underconnected_similar_audience' END AS kind
FROM links l JOIN clustered p ON p.video_id = l.a JOIN clustered q ON q.video_id = l.b LEFT JOIN shared USING (a, b) LEFT JOIN common USING (a, b)"""),
    }

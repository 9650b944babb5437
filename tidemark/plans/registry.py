"""Every relation under a name, built lazily over the canonical views of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import activity, aspects, channels, clusters, cohort, dashboard, events, graph, partition, reports, sentiment, state, themes, threads
from tidemark.plans.tables import written
from tidemark.sources.views import Views
from tidemark.streaming import rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Written tables that several relations are made of, by session, folder and name: each is made once.
_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def _shared(v: Views, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (v.spark.sparkContext.applicationId, v.folder, name)
    if key not in _SHARED:
        _SHARED[key] = written(build(), name)
    return _SHARED[key]


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Views(spark, folder))

    QUERIES[build.__name__] = run
    return build


@query
def video_metrics(v):
    return activity.video_metrics(v.comments, v.videos)


@query
def channel_overview(v):
    return activity.channel_overview(v.comments, v.videos)


@query
def commenter_activity(v):
    return activity.commenter_activity(v.comments, v.actors)


@query
def commenter_tiers(v):
    return activity.commenter_tiers(activity.with_tiers(activity.commenter_activity(v.all_comments, v.actors), v.videos, core=0.01, regular=0.005))


@query
def continuity_w4(v):
    return activity.continuity(v.actor_videos, v.videos)


@query
def continuity_sensitivity(v):
    return activity.continuity_sensitivity(v.actor_videos, v.videos)


@query
def rolling_retention(v):
    return activity.rolling_retention(v.actor_videos, v.videos)


@query
def sentiment_summary(v):
    return sentiment.sentiment_summary(v.all_comments)


@query
def sentiment_by_video(v):
    return sentiment.sentiment_by(v.all_comments, "video_id")


@query
def sentiment_by_theme(v):
    return sentiment.sentiment_by(v.all_comments.join(v.videos.select("video_id", "theme"), "video_id", "left"), "theme")


def _in_community(v):
    return v.all_comments.join(v.actors.select("actor_id", "community"), "actor_id")


@query
def community_sentiment(v):
    return sentiment.sentiment_by(_in_community(v), "community", distinct=("actor_id", "video_id"))


@query
def community_theme_sentiment(v):
    return sentiment.sentiment_by(_in_community(v).join(v.videos.select("video_id", "theme"), "video_id"), "community", "theme", distinct=("actor_id",))


@query
def reply_sentiment(v):
    flag = F.when(F.col("is_top_level"), "top_level").otherwise("reply")
    return sentiment.sentiment_by(v.all_comments.withColumn("is_top_level_label", flag), "is_top_level_label")


@query
def thread_sentiment(v):
    every = sentiment.prefixed(sentiment.sentiment_by(v.all_comments, "thread_id"), "all", "thread_id")
    replies = sentiment.prefixed(sentiment.sentiment_by(v.all_comments.where("not is_top_level"), "thread_id"), "reply", "thread_id")
    return every.join(replies, "thread_id", "left")


@query
def video_cluster_sentiment(v):
    clusters_ = v.videos.select("video_id", F.col("label").alias("video_cluster"))
    return sentiment.sentiment_by(v.all_comments.join(clusters_, "video_id"), "video_cluster", distinct=("actor_id", "video_id"))


def _judgements(v):
    """Labels of a model for the documents that have them."""
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return v.table("labels").select("doc_id", label.alias("label"), (F.col("toxic") * 0.9).alias("score_neg"))


@query
def document_sentiment(v):
    return sentiment.labelled_or_keyword(v.table("documents").select("doc_id", "text"), _judgements(v), "doc_id").select("doc_id", "label",
        "score_neg", "sentiment_source")


@query
def document_sentiment_by_words(v):
    return sentiment.labelled_or_keyword(v.table("documents").select("doc_id", "text"), None, "doc_id").select("doc_id", "label",
        "score_neg", "sentiment_source")


@query
def event_keyword_sentiment(v):
    return sentiment.event_keyword_sentiment(v.table("documents")).groupBy("lang", "label").agg(F.count("*").alias("n"))


@query
def keyword_sentiment(v):
    return sentiment.keyword_summary(v.table("documents"))


@query
def sentiment_hotspots(v):
    return sentiment.hotspots(v.all_comments, v.videos, least=5)


@query
def theme_labels_long(v):
    listed = v.videos.select("video_id", F.concat_ws(" ; ", "theme", "label", "theme").alias("labels"))
    return themes.labels_long(listed, "labels", "video_id")


def _model_labels(v):
    """Labels of a model for two in three videos: some twice, some of unknown themes."""
    p = v.table("part")
    k = F.col("p_partkey")
    names = F.array(*(F.lit(x) for x in (*themes.THEMES[:6], "no_such_theme", " food_culture ")))
    at = lambda n: F.element_at(names, (F.pmod(n, F.lit(8)) + 1).cast("int"))
    first = p.where(k % 3 != 0).select(k.alias("video_id"), F.lit(1).alias("seq"), at(k).alias("primary_theme"),
        F.concat_ws("|", at(k), at(k + 1), at(k)).alias("theme_labels"), F.lit("talk").alias("format"))
    again = p.where(k % 5 == 0).select(k.alias("video_id"), F.lit(2).alias("seq"), at(k + 3).alias("primary_theme"),
        at(k + 6).alias("theme_labels"), F.lit("vlog").alias("format"))
    return first.unionByName(again)


def _labelled_videos(v):
    return themes.label_videos(v.videos, F.concat_ws(" ", "title", "theme"), _model_labels(v))


@query
def video_theme_labels(v):
    return _labelled_videos(v)


@query
def theme_source_summary(v):
    return themes.theme_sources(_labelled_videos(v))


@query
def community_profiles(v):
    summary = graph.community_summary(_written_edges(v), _partition(v), _cores(v))
    return themes.community_profiles(_in_community(v), v.videos, summary)


@query
def bridge_profiles(v):
    best = graph.bridge_nodes(_nodes(v)).select("node", "part", "bridge")
    return activity.with_profiles(best, activity.commenter_activity(v.all_comments, v.actors))


@query
def theme_rules(v):
    found = themes.classified(v.table("documents").select("doc_id", "text"), F.col("text"))
    return found.groupBy("primary_theme", "theme_labels").agg(F.count("*").alias("n"))


@query
def theme_summary(v):
    return themes.theme_summary(v.comments, v.videos)


def _pairs(v):
    pairs = v.actor_videos.join(v.actors.select("actor_id", "community"), "actor_id").join(v.videos.select("video_id", "theme"), "video_id")
    return pairs.withColumn("_pair", F.struct("actor_id", "video_id"))


@query
def community_theme_affinity(v):
    return themes.affinity(_pairs(v), "community", "theme").drop("overall_share")


@query
def community_top_themes(v):
    counts = _pairs(v).groupBy("community", "theme").agg(F.count("*").alias("n"))
    return themes.top_text(counts, "community", F.col("theme"), "n")


def _actor_videos(v):
    """Distinct (actor, video) as a table, by as many tasks as the comments ask for: nearly all are distinct, so they are dealt first."""
    def build():
        pairs = v.all_comments.select("actor_id", "video_id")
        return pairs.repartition(graph.tasks(pairs, v.table("lineitem").count(), graph.ROWS), "actor_id", "video_id").distinct()

    return _shared(v, "actor-videos", build)


def _edges(v):
    return graph.projection(_actor_videos(v), "actor_id", "video_id")


def _partition(v):
    return v.actors.select(F.col("actor_id").alias("node"), F.col("community").alias("part"))


@query
def cocommenter_edges(v):
    return _edges(v)


def _written_edges(v):
    return _shared(v, "edges", lambda: _edges(v))


def _cores(v):
    return _shared(v, "cores", lambda: graph.core_numbers(_written_edges(v)))


def _betweenness(v):
    return _shared(v, "betweenness", lambda: graph.betweenness(_written_edges(v)))


def _nodes(v):
    return graph.node_metrics(_written_edges(v), _partition(v), _cores(v), _betweenness(v))


@query
def node_metrics(v):
    return _nodes(v)


@query
def bridge_actors(v):
    return graph.bridge_nodes(_nodes(v))


@query
def network_actor_metrics(v):
    return graph.top_nodes(_nodes(v))


@query
def community_summary(v):
    return graph.community_summary(_written_edges(v), _partition(v), _cores(v))


@query
def network_summary(v):
    return graph.network_summary(_written_edges(v), _partition(v), _cores(v))


@query
def modularity(v):
    return graph.modularity(_written_edges(v), _partition(v))


@query
def degree_assortativity(v):
    return graph.degree_assortativity(_written_edges(v))


@query
def attribute_assortativity(v):
    return graph.attribute_assortativity(_written_edges(v), _partition(v))


@query
def link_opportunities(v):
    return graph.link_opportunities(_written_edges(v))


@query
def thread_metrics(v):
    return threads.thread_report(threads.thread_metrics(v.all_comments))


@query
def reply_overview(v):
    return threads.reply_overview(v.all_comments)


@query
def theme_conflict(v):
    found = threads.thread_metrics(v.all_comments).join(v.videos.select("video_id", "theme"), "video_id")
    return threads.conflict_by(found, "theme")


@query
def video_conflict(v):
    return threads.video_conflict(threads.thread_metrics(v.all_comments), v.all_comments, v.videos)


@query
def external_daily(v):
    return events.daily_posts(v.posts)


@query
def candidate_days(v):
    return events.candidate_days(events.daily_posts(v.posts))


@query
def event_clusters(v):
    return events.event_clusters(v.posts)


@query
def merged_event_clusters(v):
    return events.event_clusters(v.posts, events.Settings(merge_cross_topic=True))


@query
def external_summary(v):
    return events.external_summary(v.posts, events.candidate_days(events.daily_posts(v.posts)), events.event_clusters(v.posts))


def _events(v):
    """Events in the comments' time: the first days of five quarters."""
    dates = ", ".join(f"({i}, date '{d}')" for i, d in enumerate(("1996-07-01", "1997-10-01", "1999-01-01", "2000-04-01", "2001-07-01")))
    return v.spark.sql(f"select * from values {dates} as t(event_id, event_start)")


@query
def event_windows(v):
    return events.event_windows(v.all_comments, _events(v))


@query
def audience_windows(v):
    return events.audience_windows(v.comments, _events(v))


@query
def half_life(v):
    return events.half_life(v.all_comments, _events(v))


@query
def spillover(v):
    return events.spillover(v.all_comments, _events(v), v.videos, least=2)


def _threads_at(v):
    return threads.thread_metrics(v.all_comments).withColumnRenamed("first_at", "ts")


def _conflicts(v):
    return events.conflict_windows(_threads_at(v), _events(v))


@query
def impact_diagnostics(v):
    e = _events(v)
    return events.impact_diagnostics(events.event_windows(v.all_comments, e), events.audience_windows(v.comments, e),
        events.newcomer_sentiment(v.comments, e), _conflicts(v), events.spillover(v.all_comments, e, v.videos, least=2))


@query
def event_conflict_lift(v):
    return events.conflict_lift(_conflicts(v))


@query
def nearby_titles(v):
    return events.nearby_titles(v.videos, _events(v))


def _aspects(v):
    """Units with list columns, as the labelling stage writes them: the theme of the video and the
    half of the year as aspects, with the comment's sentiment and its line as severity."""
    units = v.all_comments.join(v.videos.select("video_id", "theme"), "video_id")
    half = F.when(F.month("ts") <= 6, "first").when(F.month("ts") == 12, "unclear").otherwise("second")
    theme = lambda value: F.concat(F.col("theme"), F.lit("="), value)
    return units.select(
        F.xxhash64("thread_id", "line", "actor_id", "video_id", "ts").alias("unit_id"), "ts", "like_count", "label", "video_id", "actor_id",
        F.when(F.col("supplier_id") % 2 == 0, "forum_a").otherwise("forum_b").alias("platform"), F.col("theme").alias("primary_aspect"),
        F.concat_ws(";", "theme", half).alias("aspect_labels"), theme(F.when(F.col("line") == 7,
        "mixed").otherwise(F.col("label"))).alias("aspect_sentiments"),
        F.concat(theme(F.lit("9;")), theme((F.col("line") % 4).cast("string"))).alias("aspect_severities"),
        theme((F.col("line") / 8).cast("string")).alias("aspect_confidences"),
    )


_KEYED: dict[tuple[str, str], bool] = {}


def _keyed(v) -> bool:
    """Whether unit_id is a key of the units, found once a session and folder."""
    key = (v.spark.sparkContext.applicationId, v.folder)
    if key not in _KEYED:
        _KEYED[key] = _aspects(v).select("unit_id").groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return _KEYED[key]


@query
def aspect_summary(v):
    units = _aspects(v)
    return aspects.aspect_summary(aspects.aspect_rows(units), units, v.all_comments, unique=_keyed(v))


@query
def aspect_daily(v):
    return aspects.aspect_daily(aspects.aspect_rows(_aspects(v)), "platform", unique=_keyed(v))


@query
def aspect_days(v):
    return aspects.aspect_daily(aspects.aspect_rows(_aspects(v)), unique=_keyed(v))


@query
def aspect_anomalies(v):
    return aspects.aspect_anomalies(aspects.aspect_daily(aspects.aspect_rows(_aspects(v)), "platform", unique=_keyed(v)), "platform")


def _judged(v, sentiment):
    """Comments with the primary aspect of their unit, which four in five have."""
    units = _aspects(v)
    return aspects.labelled_aspects(units.drop("primary_aspect"), units.where("month(ts) % 5 <> 0").select("unit_id", "primary_aspect"), sentiment)


@query
def video_aspect_shares(v):
    return aspects.aspect_shares(_judged(v, "negative"), "video_id")


@query
def community_aspect_shares(v):
    return aspects.aspect_shares(_judged(v, "negative").join(v.actors.select("actor_id", "community"), "actor_id"), "community")


@query
def positive_aspect_shares(v):
    return aspects.aspect_shares(_judged(v, "positive"))


@query
def video_actionable_share(v):
    return aspects.actionable_share(aspects.aspect_rows(_aspects(v)), "video_id")


@query
def top_negative_comments(v):
    return aspects.top_negative(v.all_comments)


def _sections(v):
    """With graph cuts and tiers that suit the few comments of a channel in the test tables."""
    settings = channels.Settings(core=0.01, regular=0.004, core_videos=3, least_shared_videos=1, least_video_actors=2, least_shared_actors=1)
    communities, clusters_ = v.actors.select("actor_id", "community"), v.videos.select("video_id", F.col("label").alias("cluster"))
    held = ("thread_id", "line", "actor_id", "video_id", "supplier_id", "is_top_level", "like_count", "ts", "label")
    comments = _shared(v, "channel-comments", lambda: v.all_comments.select(*held).join(v.channels, "supplier_id").drop("supplier_id"))
    videos = _shared(v, "channel-videos", lambda: v.videos.select("video_id", "published_at", "view_count", "theme"))
    made = (v.spark.sparkContext.applicationId, v.folder, "section-scope") in _SHARED
    found = dict.fromkeys(channels.SECTIONS) if made else channels.sections(comments, videos, communities, clusters_, settings)
    return {name: _shared(v, f"section-{name}", lambda part=part: part) for name, part in found.items()}


def _metrics(v):
    return _shared(v, "channel-metrics", lambda: channels.metrics_of(_sections(v)))


@query
def report_documents(v):
    """What the channels' reports hold of videos, communities and themes."""
    docs = reports.report_documents(_sections(v))
    size = lambda path: F.json_array_length(F.get_json_object("report", path)).cast("bigint")
    return docs.select("channel", F.get_json_object("report", "$.channel_overview[0].n_videos_in_scope").cast("bigint").alias("n_videos"),
        size("$.community_sentiment_summary").alias("n_communities"),
        F.get_json_object("report", "$.sentiment_source_summary[0].n_scope_comments").cast("bigint").alias("n_comments"))


@query
def report_metrics(v):
    """The channels' metrics, read out of their stored reports."""
    return reports.report_metrics(reports.report_documents(_sections(v)))


@query
def channel_metrics(v):
    return _metrics(v)


@query
def metric_distributions(v):
    return cohort.distributions(_metrics(v))


@query
def metric_percentiles(v):
    return cohort.percentiles(_metrics(v))


@query
def target_comparison(v):
    return cohort.target_comparison(_metrics(v), "NATION_7")


@query
def composite_indices(v):
    return cohort.composite_indices(cohort.percentiles(_metrics(v)))


@query
def channel_archetypes(v):
    return cohort.archetypes(cohort.composite_indices(cohort.percentiles(_metrics(v))))


@query
def index_hints(v):
    return cohort.index_hints(cohort.composite_indices(cohort.percentiles(_metrics(v))))


@query
def metric_catalogue(v):
    return dashboard.metric_catalogue(cohort.distributions(_metrics(v)))


@query
def leaderboards(v):
    return cohort.leaderboards(_metrics(v))


@query
def size_bands(v):
    m = _metrics(v)
    return cohort.size_bands(m.where("metric = 'all_comments'").select("channel", F.col("value").alias("size")), m)


@query
def loglog_regression(v):
    return cohort.loglog_regression(activity.video_metrics(v.all_comments, v.videos), "view_count", "likes")


@query
def theme_contrast(v):
    return cohort.theme_contrast(community_theme_sentiment(v))


@query
def completion_report(v):
    return cohort.completion(v.table("documents"), v.table("labels"), "doc_id", "source")


@query
def connected_components(v):
    return graph.connected_components(_written_edges(v))


@query
def communities(v):
    return graph.label_communities(_written_edges(v))


@query
def core_numbers(v):
    return _cores(v)


@query
def betweenness(v):
    return _betweenness(v)


@query
def scalar_functions(v):
    """Scalar functions over generated strings of the events."""
    k = F.get_json_object("props", "$.k")
    e = v.table("events").select("event_id", "event_type", k.cast("int").alias("k"))
    iso = F.concat(F.lit("PT"), (F.col("k") % 3).cast("string"), F.lit("H"), F.col("k").cast("string"), F.lit("M"))
    url = F.concat(F.lit("https://x.test/"), F.when(F.col("k") % 3 == 0, "@").when(F.col("k") % 3 == 1, "channel/").otherwise(""),
        F.lit("Name"), F.col("k").cast("string"), F.lit("/?a=1"))
    return e.select("event_id", fn.duration_seconds(iso).alias("seconds"), fn.duration_seconds(F.concat(F.lit("P1D"), iso)).alias("bad"),
        fn.channel_key(url).alias("channel"), fn.normalized(F.concat(F.lit("  A  "), F.upper("event_type"))).alias("text"),
        fn.clamped(F.col("event_type"), ("click", "view"), "other").alias("kind"), fn.truthy(F.col("k") % 2).alias("odd"))


@query
def channel_takeaways(v):
    return dashboard.takeaways(cohort.percentiles(_metrics(v)))


@query
def risk_opportunity(v):
    return dashboard.risk_opportunity(cohort.percentiles(_metrics(v)))


@query
def metric_positions(v):
    m = _metrics(v)
    return dashboard.metric_positions(m, cohort.distributions(m))


@query
def engagement_table(v):
    return dashboard.engagement_table(activity.video_metrics(v.all_comments, v.videos))


@query
def risk_videos(v):
    return dashboard.risk_videos(sentiment_by_video(v), video_actionable_share(v), least=25)


@query
def theme_overview(v):
    return dashboard.theme_overview(theme_summary(v), sentiment_by_theme(v), theme_conflict(v), v.videos)


@query
def segment_profiles(v):
    return dashboard.segment_profiles(community_sentiment(v), community_theme_affinity(v), "community", "theme")


@query
def likes_outliers(v):
    return dashboard.likes_outliers(activity.video_metrics(v.all_comments, v.videos))


@query
def diagnostics(v):
    return dashboard.diagnostics(channel_overview(v), commenter_tiers(v), continuity_sensitivity(v), rolling_retention(v), network_summary(v),
        community_summary(v), community_theme_affinity(v), video_network_summary(v), video_cluster_summary(v), video_cluster_theme_affinity(v))


def _video_edges(v):
    """Videos by shared actors; the roles of the projection swapped."""
    return _shared(v, "video-edges", lambda: graph.projection(_actor_videos(v), "video_id", "actor_id", least_via=10, least_weight=5))


def _video_cores(v):
    return _shared(v, "video-cores", lambda: graph.core_numbers(_video_edges(v)))


@query
def shared_audience_edges(v):
    return _video_edges(v)


def _video_partition(v):
    return v.videos.select(F.col("video_id").alias("node"), F.col("label").alias("part"))


def _video_labels(v):
    """Two labels of each video."""
    return v.videos.select("video_id", F.explode(F.array("theme", F.concat_ws(" ", F.lit("brand"), "label"))).alias("label"))


def _clustered(v, edges):
    nodes = graph.degrees(edges).select("node").join(_video_partition(v), "node")
    return clusters.clustered_videos(nodes.withColumnsRenamed({"node": "video_id", "part": "cluster"}), v.videos, v.all_comments)


def _video_clusters(v):
    return _shared(v, "video-clusters", lambda: _clustered(v, _video_edges(v)))


@query
def video_network_summary(v):
    return graph.network_summary(_video_edges(v), _video_partition(v), _video_cores(v))


@query
def video_network_metrics(v):
    nodes = graph.node_metrics(_video_edges(v), _video_partition(v), _video_cores(v), graph.betweenness(_video_edges(v)))
    return nodes.join(v.videos.select(F.col("video_id").alias("node"), "title", "published_at"), "node")


@query
def video_community_summary(v):
    return graph.community_summary(_video_edges(v), _video_partition(v), _video_cores(v))


@query
def video_clusters(v):
    return _clustered(v, _video_edges(v))


def _found(v, algorithm):
    return _shared(v, f"video-{algorithm}", lambda: partition.detected(_video_edges(v), algorithm)[0])


@query
def video_communities(v):
    """Clusters of videos by the first choice of the search: moves with refinement."""
    return _found(v, "auto")


@query
def video_modules(v):
    """Clusters of videos that a random walk stays in."""
    return _found(v, "infomap")


@query
def video_communities_greedy(v):
    return _found(v, "greedy")


@query
def video_partition_checks(v):
    """Of each partition: its nodes, whether all of its parts are connected, and whether its modularity is above that
    of the labels and that of each node alone."""
    edges, out = _video_edges(v), None
    labels = graph.modularity(edges, _video_partition(v)).first()[0] or 0.0
    for name in ("auto", "infomap", "greedy"):
        found = _found(v, name)
        whole = partition.whole(edges, found).agg(F.countDistinct("part")).first()[0]
        row = found.agg(F.lit(name).alias("algorithm"), F.count("*").alias("n_nodes"), (F.countDistinct("part") == whole).alias("connected"))
        row = row.crossJoin(graph.modularity(edges, found).select((F.coalesce("modularity", F.lit(0.0)) >= max(labels, 0.0)).alias("better")))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query
def video_cluster_summary(v):
    return clusters.cluster_summary(_video_clusters(v), v.all_comments, _video_labels(v))


@query
def video_cluster_theme_affinity(v):
    return clusters.cluster_affinity(_video_clusters(v), _video_labels(v))


@query
def video_opportunities(v):
    edges = _video_edges(v)
    found = written(graph.link_opportunities(edges), "opportunities")
    return clusters.described_opportunities(found, edges, _clustered(v, edges), v.actor_videos)


@query
def video_cluster_profiles(v):
    structure = graph.community_summary(_video_edges(v), _video_partition(v), _video_cores(v))
    return dashboard.video_cluster_profiles(video_cluster_summary(v), structure, video_cluster_sentiment(v), video_cluster_theme_affinity(v))


@query
def community_mood(v):
    return dashboard.sentiment_profile(community_sentiment(v), "community")


@query
def negative_sources(v):
    return dashboard.negative_sources(sentiment_by_theme(v), "theme")


def _indices(v):
    return cohort.composite_indices(cohort.percentiles(_metrics(v)))


@query
def analysis_lenses(v):
    return dashboard.analysis_lenses(_indices(v))


@query
def channel_documents(v):
    ranks, indices = cohort.percentiles(_metrics(v)), _indices(v)
    out = dashboard.channel_documents(_metrics(v), ranks, indices, cohort.archetypes(indices), dashboard.story_cards(indices))
    return out.withColumn("n_metrics", F.size("metrics")).drop("metrics")


@query
def baseline_summary(v):
    return dashboard.baseline_summary(_metrics(v), cohort.percentiles(_metrics(v)))


@query
def shown_metrics(v):
    """Metrics as dashboards write them, and which third of the cohort they lie in."""
    r = cohort.percentiles(_metrics(v))
    return r.select("channel", "metric", fn.shown_number(F.col("value")).alias("number"), fn.shown_decimal(F.col("value")).alias("decimal"),
        fn.shown_rate(F.col("value")).alias("rate"), fn.rank_band(F.col("percentile")).alias("third"))


@query
def shown_estimates(v):
    out = runtime_estimates(v)
    return out.select("stage", fn.shown_range(F.col("low_seconds"), F.col("high_seconds")).alias("shown"))


@query
def ranked_theme_items(v):
    """The top-themes text of each community taken apart again."""
    items = fn.ranked_items(F.col("top"))
    return community_top_themes(v).select("community", F.posexplode(items).alias("place", "item")).select("community", "place", "item.label", "item.count")


def _queue(v):
    """Orders as a work queue: their state, with an error text for some."""
    status = F.when(F.col("o_orderstatus") == "F", "graphed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"), status.alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Quota "), F.col("o_orderpriority"))).alias("last_error"),
        F.col("o_orderdate").alias("updated_at"))


@query
def queue_status(v):
    return state.queue_status(_queue(v))


@query
def queue_after_reset(v):
    return state.queue_status(state.reset_stale(_queue(v), "2002-01-01 00:00:00"))


@query
def remaining_units(v):
    done = v.table("labels").withColumn("parse_error", (F.col("quality") == 0).cast("string"))
    return state.remaining(v.table("documents").select("doc_id", "source"), done, "doc_id", error="parse_error")


@query
def runtime_estimates(v):
    counts = v.videos.agg(F.count("*").alias("units")).select(F.lit("video").alias("stage"),
        "units").unionByName(v.all_comments.agg(F.count("*").alias("units")).select(F.lit("sentiment").alias("stage"), "units"))
    return state.runtime_estimates(counts)


@query
def daily_topic_counts(v):
    return rates.daily_counts(v.posts)


@query
def author_sessions(v):
    return rates.sessions(v.posts)


@query
def sliding_topic_counts(v):
    return rates.sliding_counts(v.posts)


@query
def posts_followed(v):
    return rates.followed_by(v.posts, v.posts, within="6 hours")


@query
def sentiment_cube(v):
    """An extension: the measures over all subsets of (community, theme)."""
    rows = _in_community(v).join(v.videos.select("video_id", "theme"), "video_id")
    return rows.cube("community", "theme").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"),
        F.count_if(F.col("label") == "negative").alias("n_negative"))


@query
def comment_gaps(v):
    """An extension: days between an actor's comments, and the longest."""
    from pyspark.sql import Window

    gap = F.date_diff(F.to_date("ts"), F.to_date(F.lag("ts").over(Window.partitionBy("actor_id").orderBy("ts"))))
    return v.all_comments.select("actor_id", gap.alias("gap")).groupBy("actor_id").agg(F.count("gap").alias("n_gaps"), F.max("gap").alias("longest"))


def _clusters(v):
    """Spans of days over the posts: thirds of a month."""
    spans = ", ".join(f"({i}, date '{a}', date '{b}')" for i, (a, b) in enumerate((("2024-01-01", "2024-01-09"),
        ("2024-01-10", "2024-01-19"), ("2024-01-20", "2024-01-30"))))
    return v.spark.sql(f"select * from values {spans} as t(event_id, event_start, event_end)")


@query
def cluster_topics(v):
    days = _clusters(v).select("event_id", F.explode(F.sequence("event_start", "event_end")).alias("day"))
    return events.topic_votes(v.posts.drop("event_id").join(days, "day"), "event_id")


@query
def conflict_windows(v):
    return _conflicts(v)


@query
def newcomer_sentiment(v):
    return events.newcomer_sentiment(v.comments, _events(v))


@query
def audience_summary(v):
    return events.audience_summary(events.audience_windows(v.comments, _events(v)))


@query
def platform_aspect_shares(v):
    return aspects.aspect_shares(aspects.aspect_rows(_aspects(v)).where("sentiment = 'negative'"), "platform")


def _texts(v):
    """Documents as comments with a label."""
    docs = v.table("documents").join(v.table("labels"), "doc_id", "left")
    return docs.select("doc_id", "text", "source", F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1,
        "positive").otherwise("neutral").alias("label"))


@query
def scored_units(v):
    return aspects.comment_units(_texts(v), "negative_or_keyword").select("doc_id", "label", "aspect_keyword_hits")


@query
def external_units(v):
    return aspects.external_units(v.posts)


@query
def metric_spotlight(v):
    m = _metrics(v)
    return dashboard.spotlight(m, cohort.distributions(m))


@query
def story_cards(v):
    return dashboard.story_cards(cohort.composite_indices(cohort.percentiles(_metrics(v))))


@query
def video_timeline(v):
    return dashboard.video_timeline(video_metrics(v), sentiment_by_video(v), _events(v))


@query
def label_coverage(v):
    return sentiment.source_row(v.table("documents"), v.table("labels"), "doc_id")


@query
def video_extremes(v):
    return sentiment.video_extremes(v.all_comments)


@query
def conversation_turns(v):
    """Reply threads as conversations: turns, roles, and words of parents and replies."""
    words = F.regexp_count("text", F.lit(r"\S+"))
    c = v.table("conversations").withColumn("words", words)
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.countDistinct("role").alias("n_roles"),
        F.coalesce(F.sum(F.when(F.col("turn") == 0, F.col("words"))), F.lit(0)).alias("parent_words"),
        F.coalesce(F.sum(F.when(F.col("turn") > 0, F.col("words"))), F.lit(0)).alias("reply_words"))


from tidemark.plans import labels, work  # noqa: E402, F401  (add their relations)

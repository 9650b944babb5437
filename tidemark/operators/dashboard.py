"""What dashboards show: takeaways, spotlights, profiles, cards and outliers, as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import places, ratio, shown_rate
from tidemark.operators.channels import metric_group, metric_polarity, metric_unit

def with_polarity(ranks: DataFrame) -> DataFrame:
    """ranks with the metric's polarity and what its percentile means: risk, opportunity, watch, context."""
    out = ranks.withColumn("polarity", metric_polarity(F.col("metric")))
    p, high, low = F.col("polarity"), F.col("percentile") >= 75, F.col("percentile") <= 25
    outer = p.isin("concentration_high", "mixed_high") & (high | low)
    reading = F.when((p == "risk_high") & high, "risk").when((p == "risk_high") & low, "opportunity").when((p == "benefit_high") & high,
        "opportunity").when((p == "benefit_high") & low, "risk").when(outer, "watch").otherwise("context")
    return out.withColumn("reading", reading)


def metric_catalogue(spread: DataFrame) -> DataFrame:
    """Every metric with its group, unit, polarity and distribution."""
    m = F.col("metric")
    return spread.withColumns({"metric_group": metric_group(m), "unit": metric_unit(m), "polarity": metric_polarity(m),
        "iqr": places(F.col("p75") - F.col("p25"), 9)})


def takeaways(ranks: DataFrame, *, k: int = 8) -> DataFrame:
    """Per channel the k metrics furthest from the middle, of those in the outer quarters."""
    out = with_polarity(ranks).where("percentile <= 25 or percentile >= 75").withColumn("extremeness", F.abs(F.col("percentile") - 50))
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("extremeness"), "metric"))
    return out.withColumn("place", place).where(F.col("place") <= k).select("channel", "place", "metric", "percentile", "reading")


def risk_opportunity(ranks: DataFrame, *, k: int = 5) -> DataFrame:
    """Per channel and reading the k most extreme metrics."""
    out = with_polarity(ranks).withColumn("extremeness", F.abs(F.col("percentile") - 50))
    place = F.row_number().over(Window.partitionBy("channel", "reading").orderBy(F.desc("extremeness"), "metric"))
    return out.withColumn("place", place).where(F.col("place") <= k).select("channel", "reading", "place", "metric", "percentile")


def value_percentile(value: Column, points: list[tuple[float, Column]]) -> Column:
    """The percentile of a value by straight lines between (percentile, breakpoint) pairs in rising
    order; beyond them the outer percentile."""
    out = F.when(value <= points[0][1], points[0][0])
    for (p, a), (q, b) in zip(points, points[1:]):
        out = out.when(value <= b, p + (q - p) * F.coalesce(ratio(value - a, b - a), F.lit(0.0)))
    return out.otherwise(points[-1][0])


def metric_positions(metrics: DataFrame, spread: DataFrame) -> DataFrame:
    """Each value against its metric's distribution: percentile by interpolation, distance from the
    median in interquartile ranges, and which part of the box it lies in."""
    d = metrics.join(spread.select("metric", "least", "p10", "p25", "median", "p75", "p90", "most"), "metric")
    points = [(0.0, F.col("least")), (10.0, F.col("p10")), (25.0, F.col("p25")), (50.0, F.col("median")), (75.0, F.col("p75")),
        (90.0, F.col("p90")), (100.0, F.col("most"))]
    v = F.col("value")
    part = F.when(v < F.col("p25"), "below_iqr").when(v > F.col("p75"), "above_iqr").otherwise("inside_iqr")
    return d.select("channel", "metric", "value", places(value_percentile(v, points), 4).alias("position"),
        places(ratio(v - F.col("median"), F.col("p75") - F.col("p25")), 4).alias("iqr_distance"), part.alias("part"))


def engagement_table(videos: DataFrame, *, k: int = 12) -> DataFrame:
    """Videos by comments for a thousand views."""
    rate = places(ratio(1000 * F.col("n_comments"), F.col("view_count")))
    return videos.select("video_id", "title", "n_comments", "view_count",
        rate.alias("per_1k_views")).orderBy(F.desc_nulls_last("per_1k_views"), "video_id").limit(k)


def risk_videos(blocks: DataFrame, actionable: DataFrame | None = None, *, least: int = 50, k: int = 6) -> DataFrame:
    """Videos of enough comments (all where none has enough) by the negative rate, weighted where that is not 0, times the
    share of their negative comments on aspects that can be acted on. actionable: (video_id, actionable); a video without
    a share counts whole."""
    some = blocks.agg(F.coalesce(F.max(F.col("n") >= least), F.lit(False)).alias("_some"))  # one row
    out = blocks.crossJoin(F.broadcast(some)).where((F.col("n") >= least) | ~F.col("_some"))
    share = F.lit(None).cast("double").alias("actionable")
    out = out.select("*", share) if actionable is None else out.join(actionable.select("video_id", "actionable"), "video_id", "left")
    rate = F.coalesce(F.nullif("weighted_negative_rate", F.lit(0.0)), "negative_rate", F.lit(0.0))
    out = out.select("video_id", "n", "negative_rate", "weighted_negative_rate", "actionable", places(rate * F.coalesce("actionable",
        F.lit(1.0))).alias("score"))
    return out.orderBy(F.desc("score"), "video_id").limit(k)


def theme_overview(summary: DataFrame, sentiment: DataFrame, conflict: DataFrame, views: DataFrame) -> DataFrame:
    """Themes with their comments, sentiment, conflict, and comments for a thousand views."""
    out = summary.join(sentiment.select("theme", "negative_rate", "positive_rate"), "theme",
        "left").join(conflict.select("theme", "conflict_rate_replied", "conflict_score"), "theme",
        "left").join(views.groupBy("theme").agg(F.sum("view_count").alias("views")), "theme", "left")
    return out.withColumn("per_1k_views", places(ratio(1000 * F.col("n_comments"), F.col("views"))))


def segment_profiles(blocks: DataFrame, affinities: DataFrame, group: str, label: str, *, k: int = 3) -> DataFrame:
    """Groups with comments for each commenter, their commonest sentiment, and top labels by lift."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), label))
    top = affinities.withColumn("_place",
        place).where(F.col("_place") <= k).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place",
        label))), lambda x: x[label]), ";").alias("top_labels"))
    dominant = F.array_max(F.array(*(F.struct(F.col(f"n_{x}").alias("n"), F.lit(x).alias("label")) for x in ("negative", "neutral", "positive"))))["label"]
    return blocks.select(group, "n", "n_actors", places(ratio(F.col("n"), F.col("n_actors"))).alias("comments_per_commenter"),
        dominant.alias("dominant")).join(top, group, "left")


def likes_outliers(videos: DataFrame, *, least_views: int = 1000, k: int = 8) -> DataFrame:
    """Videos furthest above or below the line of log likes on log views, by residual deviations
    (n - 2 degrees of freedom); views count from the larger of least_views and the tenth percentile."""
    rows = videos.select("video_id", "view_count", "likes", F.log10(F.col("view_count") + 1.0).alias("x"), F.log10(F.col("likes") + 1.0).alias("y"))
    line = rows.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.percentile("view_count", 0.1).alias("p10"))
    own = rows.crossJoin(F.broadcast(line)).withColumn("r", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    spread = own.agg(F.sqrt(F.sum(F.col("r") * F.col("r")) / (F.count("*") - 2)).alias("sd"))
    out = own.crossJoin(F.broadcast(spread)).where(F.col("view_count") >= F.greatest(F.lit(float(least_views)), F.col("p10")))
    out = out.select("video_id", "view_count", "likes", places(ratio(F.col("r"), F.col("sd")), 4).alias("z"),
        places(F.pow(F.lit(10.0), F.col("r")), 4).alias("lift"))
    return out.orderBy(F.desc(F.abs("z")), "video_id").limit(k)


def top_major_affinity(affinities: DataFrame, group: str, label: str, *, size: str, least: float = 1.2, part: float = 0.25) -> DataFrame:
    """The greatest lift, from `least` up, of a label other than `other` in a group of at least `part` of the largest group's
    size, as (subject, value); ties: the larger group, then the subject. No row where there is none."""
    most = affinities.agg(F.max(size).alias("_most"))  # one row
    major = affinities.crossJoin(F.broadcast(most)).where((F.col(size) >= part * F.col("_most")) & (F.col("_most") > 0))
    major = major.where((F.col(label) != "other") & (F.col("lift") >= least)).withColumn("subject", F.concat(group, F.lit(":"), label))
    return major.orderBy(F.desc("lift"), F.desc(size), F.asc_nulls_last("subject")).limit(1).select("subject", F.col("lift").alias("value"))


def diagnostics(overview: DataFrame, tiers: DataFrame, sensitivity: DataFrame, rolling: DataFrame, network: DataFrame, communities: DataFrame,
        affinities: DataFrame, video_network: DataFrame, clusters: DataFrame, cluster_affinities: DataFrame, *, low: str = "one_time", high: str = "core",
        casual: float = 80, steady: float = 0.08) -> DataFrame:
    """Ten findings of a report: (area, metric, subject, value, most, reading). `most` is the upper end of a range, or what
    belongs to the value: the share of the largest part, or the effective number of communities. A finding whose tables
    are empty has no row."""

    def finding(df, area, metric, value, most=None, reading="", subject=None):
        number = lambda c: places(c.cast("double")) if c is not None else F.lit(None).cast("double")
        return df.select(F.lit(area).alias("area"), F.lit(metric).alias("metric"), (F.lit(None).cast("string") if subject is None else subject).alias("subject"),
            number(value).alias("value"), number(most).alias("most"), (F.lit(reading) if isinstance(reading, str) else reading).alias("reading"))

    c = F.col
    span = lambda df, rate: df.agg(F.min(rate).alias("low"), F.max(rate).alias("high")).where("high is not null")
    windows, turns = span(sensitivity, "weighted_return_rate"), span(rolling, "return_rate")
    net = network.crossJoin(communities.agg(F.max_by("pct_nodes", "n_nodes").alias("largest"))).where("largest is not null")  # one row each
    held = clusters.agg(F.max("n_videos").alias("largest")).where("largest is not null")
    videos = video_network.crossJoin(held).crossJoin(overview.select(c("n_videos").alias("n_scope")))  # one row each
    audience = "audience_structure"
    rows = [
        finding(tiers.where(c("tier") == low), "audience_mix", "low_tier_share", c("pct_commenters"),
            reading=F.when(c("pct_commenters") >= casual, "casual_heavy").otherwise("repeat_base")),
        finding(tiers.where(c("tier") == high), "audience_mix", "high_tier_commenters", c("n_commenters"), reading="measurable_core"),
        finding(windows, "retention", "window_sensitivity_return_range", c("low"), c("high"),
            F.when(places(c("high") - c("low")) <= steady, "stable").otherwise("depends_on_windows")),
        finding(turns, "retention", "rolling_return_range", c("low"), c("high"), "over_time"),
        finding(net, audience, "audience_communities", c("n_communities"), c("largest"), "largest_share"),
        finding(net, audience, "community_concentration_hhi", c("hhi"), c("effective_communities"), "effective_communities"),
        finding(net, audience, "max_k_core", c("max_core"), reading="embeddedness"),
        finding(top_major_affinity(affinities, "community", "theme", size="group_pairs"), audience, "top_audience_affinity", c("value"),
            reading="over_indexes", subject=c("subject")),
        finding(videos, "content_portfolio", "video_shared_audience_clusters", c("n_communities"), 100 * ratio(c("largest"), c("n_scope")),
            "largest_share"),
        finding(top_major_affinity(cluster_affinities, "cluster", "label", size="cluster_videos"), "content_portfolio", "top_video_cluster_affinity",
            c("value"), reading="over_indexes", subject=c("subject")),
    ]
    return reduce(DataFrame.unionByName, rows)


def spotlight(metrics: DataFrame, spread: DataFrame, *, k: int = 3) -> DataFrame:
    """Of each metric the k highest and lowest channels beside its median."""
    high = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "channel"))
    low = F.row_number().over(Window.partitionBy("metric").orderBy("value", "channel"))
    name = lambda place: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(place) <= k, F.struct(place, "channel")))),
        lambda x: x["channel"]), ";")
    out = metrics.withColumn("_high", high).withColumn("_low", low).groupBy("metric").agg(name("_high").alias("highest"), name("_low").alias("lowest"))
    return out.join(spread.select("metric", "n", "median"), "metric")


def story_cards(indices: DataFrame, *, high: float = 65, low: float = 35, k: int = 9) -> DataFrame:
    """Per channel: cards for indices at the ends, by priority (60 for a risk, 50 for a strength,
    and the distance from the middle); the first five are what to decide on."""
    score = F.col("score")
    risk = (F.col("index_name") == "risk_pressure") == (score >= high)
    kind = F.when(risk, "risk").otherwise("strength")
    cards = indices.where((score >= high) | (score <= low)).withColumn("kind", kind)
    cards = cards.withColumn("priority", places(F.when(F.col("kind") == "risk", 60).otherwise(50) + F.abs(score - 50), 4))
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("priority"), "index_name"))
    return cards.withColumn("place", place).where(F.col("place") <= k).select("channel", "place", "index_name", "kind", "priority",
        (F.col("place") <= 5).alias("decide"))


def video_timeline(metrics: DataFrame, blocks: DataFrame, events: DataFrame) -> DataFrame:
    """Videos in time with comments, views, negative rate, and the events of the week after."""
    days = events.select("event_id", F.explode(F.sequence(F.date_sub("event_start", 7), F.col("event_start"))).alias("day"))
    marked = days.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set(F.col("event_id").cast("string"))), ";").alias("events"))
    out = metrics.join(blocks.select("video_id", "negative_rate"), "video_id", "left").withColumn("day", F.to_date("published_at"))
    return out.join(marked, "day", "left").select("video_id", "day", "n_comments", "view_count", "negative_rate", "events")


# The lenses of an analysis and the indices that each looks at.
LENSES = {
    "executive": ("engagement_conversion", "audience_stickiness", "conversation_quality", "risk_pressure"),
    "audience": ("engagement_conversion", "audience_stickiness", "community_concentration"),
    "content": ("content_portfolio_linkage", "engagement_conversion", "audience_stickiness"),
}


def sentiment_profile(blocks: DataFrame, *keys: str) -> DataFrame:
    """Rates of a block with the dominant label (ties: negative, neutral, positive) and how it reads."""
    neg, neu, pos = (F.col(f"{x}_rate") for x in ("negative", "neutral", "positive"))
    dominant = F.when((neg >= neu) & (neg >= pos), "negative").when(neu >= pos, "neutral").otherwise("positive")
    reading = F.when((F.col("dominant") == "positive") & (neg < 0.1), "mostly_positive").when(F.col("dominant") == "positive",
        "positive_but_watch_negative").when(F.col("dominant") == "neutral", "mostly_neutral").otherwise("negative_high")
    out = blocks.withColumn("dominant", dominant).withColumn("sentiment_reading", reading)
    return out.select(*keys, "dominant", "sentiment_reading", "negative_rate", "neutral_rate", "positive_rate", "weighted_negative_rate",
        "weighted_positive_rate")


def shared_audience_reading(conductance: Column) -> Column:
    return F.when(conductance.isNull(), "unknown").when(conductance < 0.4, "tight").when(conductance < 0.7, "bridging").otherwise("loose")


def video_cluster_profiles(summary: DataFrame, structure: DataFrame, blocks: DataFrame, affinity: DataFrame, *, k: int = 4) -> DataFrame:
    """Per cluster: its summary, sentiment, the k labels of greatest lift (then of most videos), and how its
    audience is shared with others. structure: community_summary of the video graph."""
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("lift"), F.desc("n_videos"), "label"))
    best = affinity.withColumn("_place", place).where(F.col("_place") <= k)
    items = F.array_sort(F.collect_list(F.struct("_place", "label")))
    over = best.groupBy("cluster").agg(F.array_join(items["label"], "; ").alias("over_indexed"))
    shared = structure.select(F.col("part").alias("cluster"), "internal_edges", "external_edges", "conductance",
        shared_audience_reading(F.col("conductance")).alias("shared_audience"))
    mood = sentiment_profile(blocks.withColumnRenamed("video_cluster", "cluster"), "cluster")
    return summary.join(shared, "cluster", "left").join(mood, "cluster", "left").join(over, "cluster", "left")


def negative_sources(blocks: DataFrame, key: str, *, least: int = 50, k: int = 3) -> DataFrame:
    """The k groups of highest weighted negative rate, of those with enough comments."""
    place = F.row_number().over(Window.orderBy(F.desc("weighted_negative_rate"), F.desc("n"), key))  # of k rows
    best = blocks.where(F.col("n") >= least).orderBy(F.desc("weighted_negative_rate"), F.desc("n"), key).limit(k)
    return best.select(place.alias("place"), key, "n", "negative_rate", "weighted_negative_rate", shown_rate(F.col("negative_rate")).alias("shown"))


def analysis_lenses(indices: DataFrame) -> DataFrame:
    """Per channel and lens: the mean of its indices that there are, and how many."""
    rows = [(lens, i) for lens, names in LENSES.items() for i in names]
    table = indices.sparkSession.createDataFrame(rows, "lens string, index_name string")
    return indices.join(F.broadcast(table), "index_name").groupBy("channel", "lens").agg(places(F.avg("score"), 4).alias("score"),
        F.count("*").alias("n_indices"))


def channel_documents(metrics: DataFrame, ranks: DataFrame, indices: DataFrame, archetypes: DataFrame, cards: DataFrame) -> DataFrame:
    """One document a channel: its metrics as a map, archetype, best and worst index, readings, and what to
    decide on first. Documents are rows; `to_json` makes them text where a sink wants that."""
    own = metrics.groupBy("channel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    best = indices.groupBy("channel").agg(F.max_by("index_name", F.struct("score", "index_name")).alias("best_index"),
        F.min_by("index_name", F.struct("score", "index_name")).alias("worst_index"))
    kinds = ("risk", "opportunity", "watch", "context")
    readings = with_polarity(ranks).groupBy("channel").agg(*(F.count_if(F.col("reading") == x).alias(f"n_{x}") for x in kinds))
    queue = F.array_sort(F.collect_list(F.when(F.col("decide"), F.struct("place", "index_name"))))
    decide = cards.groupBy("channel").agg(F.array_join(queue["index_name"], ";").alias("decision_queue"))
    return own.join(archetypes, "channel", "left").join(best, "channel", "left").join(readings, "channel", "left").join(decide, "channel", "left")


def baseline_summary(metrics: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: channels, metrics and rows of the cohort, and the totals of its videos and comments."""
    total = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).cast("bigint")
    out = metrics.agg(F.countDistinct("channel").alias("n_channels"), F.countDistinct("metric").alias("n_metrics"),
        F.count("*").alias("n_values"), total("n_videos_in_scope").alias("videos"), total("all_comments").alias("comments"),
        total("top_level_commenters").alias("commenters"))
    return out.crossJoin(ranks.agg(F.count("*").alias("n_percentiles")))  # one row each


def channel_rows(rows: DataFrame, *, channel_id: str = "", slug: str = "", title: str = "") -> DataFrame:
    """Rows of one channel: by its id, by a run folder that ends in its slug, or by its title."""
    tests = []
    if channel_id and "channel_id" in rows.columns:
        tests.append(F.col("channel_id").cast("string") == channel_id)
    if slug and "run_dir" in rows.columns:
        tests.append((F.col("run_dir") == f"runs/{slug}") | F.col("run_dir").endswith(f"/{slug}"))
    if title and "run_channel_title" in rows.columns:
        tests.append(F.col("run_channel_title") == title)
    keep = F.lit(False)
    for t in tests:
        keep = keep | F.coalesce(t, F.lit(False))
    return rows.where(keep)

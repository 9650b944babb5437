"""Channels side by side: metrics in long form, distributions, ranks, indices, boards, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import percentile_band, places, ratio

# Component metrics of each index (a minus inverts the percentile), how a high score is
# read, and the metrics that have leaderboards.
INDICES = {
    "engagement_conversion": ["comments_per_1k_views", "comments_per_video", "commenters_per_video"],
    "audience_stickiness": ["high_mid_tier_commenter_share", "high_mid_tier_comment_share", "continuity_return_rate_w4", "rolling_return_rate_latest"],
    "conversation_quality": ["positive_rate", "-negative_rate", "-like_weighted_negative_rate", "-reply_negative_rate"],
    "risk_pressure": ["negative_rate", "like_weighted_negative_rate", "max_video_like_weighted_negative_rate", "max_video_like_weighted_conflict_score"],
    "community_concentration": ["largest_community_share", "top3_community_share", "community_hhi"],
    "content_portfolio_linkage": ["video_network_density", "video_network_modularity", "top_bridge_participation_mean"],
}
INDEX_POLARITY = {"risk_pressure": "risk_high", "community_concentration": "mixed_high", "content_portfolio_linkage": "mixed_high"}
LEADERBOARD_METRICS = ("comments_per_1k_views", "high_mid_tier_commenter_share", "continuity_return_rate_w4", "community_hhi",
    "negative_rate", "like_weighted_negative_rate", "reply_share_all_comments", "max_video_like_weighted_conflict_score")


def distributions(metrics: DataFrame) -> DataFrame:
    """Per metric: n, mean, median, population deviation, extremes and quantiles (linear).

    Values have six places, so middles of two have seven: nine are kept."""
    q = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    return metrics.groupBy("metric").agg(F.count("*").alias("n"), places(F.avg("value"), 9).alias("mean"),
        places(F.stddev_pop("value"), 9).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"),
        *(places(F.percentile("value", p), 9).alias(k) for k, p in q.items()))


def percentiles(metrics: DataFrame) -> DataFrame:
    """Average-tie percentile rank of each channel in each metric, and its band."""
    by = Window.partitionBy("metric")
    rank = (F.rank().over(by.orderBy("value")) + (F.count("*").over(Window.partitionBy("metric", "value")) - 1) / 2) / F.count("*").over(by)
    out = metrics.withColumn("percentile", places(100 * rank)).withColumn("cohort_n", F.count("*").over(by))
    return out.select("channel", "metric", "value", "percentile", "cohort_n", percentile_band(F.col("percentile")).alias("band"))


def target_comparison(metrics: DataFrame, target: str) -> DataFrame:
    """The target's metrics against all channels: share at or below, distance from the median."""
    own = metrics.where(F.col("channel") == target).select("metric", F.col("value").alias("target"))
    out = metrics.join(F.broadcast(own), "metric").groupBy("metric",
        "target").agg((100 * F.avg((F.col("value") <= F.col("target")).cast("double"))).alias("p"), F.percentile("value", 0.5).alias("m"))
    return out.select("metric", "target", places(F.col("p")).alias("percentile"), places(F.col("m"), 9).alias("median"),
        places(F.col("target") - F.col("m"), 9).alias("delta"), places(ratio(F.col("target"), F.col("m")), 9).alias("ratio"))


def composite_indices(ranks: DataFrame) -> DataFrame:
    """Per channel and index: the mean of its component percentiles, some of them inverted."""
    spec = [(index, m.removeprefix("-"), m.startswith("-")) for index, parts in INDICES.items() for m in parts]
    table = ranks.sparkSession.createDataFrame(spec, "index_name string, metric string, inverted boolean")
    score = F.when(F.col("inverted"), 100 - F.col("percentile")).otherwise(F.col("percentile"))
    return ranks.join(F.broadcast(table), "metric").groupBy("channel", "index_name").agg(places(F.avg(score), 4).alias("score"),
        F.count("*").alias("n_components"))


def score_band(score: Column) -> Column:
    """Which fifth or so of the scale a score lies in (bounds are fixed values)."""
    return F.when(score.isNull(), "unknown").when(score >= 80, "very_high").when(score >= 65, "high").when(score >= 40,
        "middle").when(score >= 25, "low").otherwise("very_low")


def index_hints(indices: DataFrame) -> DataFrame:
    """Scores with their band, the index's polarity, and whether its high or its low reading applies."""
    known = F.create_map(*(F.lit(x) for kv in INDEX_POLARITY.items() for x in kv))
    polarity = F.coalesce(F.try_element_at(known, F.col("index_name")), F.lit("benefit_high"))
    hint = F.when(F.col("score") >= 65, "high").when(F.col("score") <= 35, "low").otherwise("middle")
    return indices.withColumns({"band": score_band(F.col("score")), "polarity": polarity, "hint": hint})


def archetypes(indices: DataFrame) -> DataFrame:
    """(channel, archetype): the first rule over the six indices that holds (their bounds are fixed values);
    missing indices count 0."""
    at = lambda k: F.coalesce(F.max(F.when(F.col("index_name") == k, F.col("score"))), F.lit(0.0)).alias(k)
    wide = indices.groupBy("channel").agg(*(at(k) for k in INDICES))
    e, s, q, r, c, li = (F.col(k) for k in INDICES)
    rule = (
        F.when((e >= 65) & (r >= 65), "high_engagement_high_risk").when((e >= 65) & (s >= 60) & (r < 60),
        "steady_discussion").when((s >= 65) & (c >= 65), "core_circle")
        .when((li >= 65) & (e >= 50), "expandable_portfolio").when((q >= 65) & (e < 45), "quiet_potential").when((e < 40) & (s < 40),
        "low_participation").otherwise("balanced")
    )
    return wide.select("channel", rule.alias("archetype"))


def leaderboards(metrics: DataFrame, *, k: int = 5) -> DataFrame:
    """The k best and k worst channels of each leaderboard metric with their places."""
    metrics = metrics.where(F.col("metric").isin(*LEADERBOARD_METRICS))
    top = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "channel"))
    low = F.row_number().over(Window.partitionBy("metric").orderBy("value", "channel"))
    out = metrics.withColumn("top", top).withColumn("low", low).where((F.col("top") <= k) | (F.col("low") <= k))
    sides = F.filter(F.array(F.struct(F.lit("top").alias("board"), F.col("top").alias("place")),
        F.struct(F.lit("bottom").alias("board"), F.col("low").alias("place"))), lambda x: x["place"] <= k)
    return out.select("metric", "channel", "value", F.explode(sides).alias("s")).select("metric", "channel", "value", "s.*")


def size_bands(sizes: DataFrame, metrics: DataFrame, *, bounds: tuple[int, ...] = (0, 1000, 2000)) -> DataFrame:
    """Distribution of each metric over channels of at least each bound (bands are cumulative);
    the sample deviation, 0 for one channel."""
    bands = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("size"))
    held = sizes.select("channel", F.explode(bands).alias("at_least"))
    return metrics.join(held, "channel").groupBy("at_least", "metric").agg(F.count("*").alias("n"), places(F.avg("value"), 9).alias("mean"),
        places(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 9).alias("sd"), places(F.percentile("value", 0.5), 9).alias("median"))


def loglog_regression(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of log10(y + 1) on log10(x + 1), one row: slope, intercept, R2, n."""
    lx, ly = F.log10(F.col(x) + 1.0), F.log10(F.col(y) + 1.0)
    return rows.select(lx.alias("lx"), ly.alias("ly")).agg(F.count("*").alias("n"), places(F.regr_slope("ly", "lx"), 5).alias("slope"),
        places(F.regr_intercept("ly", "lx"), 4).alias("intercept"), places(F.regr_r2("ly", "lx")).alias("r2"))


def theme_contrast(cells: DataFrame, *, least: int = 150, spread: float = 0.0, k: int = 6) -> DataFrame:
    """Themes whose negative rate differs most between communities: (theme, community, n,
    negative_rate) cells of at least `least`, two communities at least."""
    out = cells.where((F.col("n") >= least) & (F.col("theme") != "other")).groupBy("theme").agg(F.count("*").alias("n_communities"),
        places(F.max("negative_rate") - F.min("negative_rate")).alias("spread"))
    return out.where((F.col("n_communities") >= 2) & (F.col("spread") >= spread)).orderBy(F.desc("spread"), "theme").limit(k)


def completion(wanted: DataFrame, done: DataFrame, key: str, group: str) -> DataFrame:
    """Per group: rows wanted, done and left."""
    out = wanted.join(done.select(key).distinct().withColumn("_done", F.lit(1)), key,
        "left").groupBy(group).agg(F.count("*").alias("wanted"), F.count("_done").alias("done"))
    return out.select(group, "wanted", "done", (F.col("wanted") - F.col("done")).alias("remaining"),
        places(ratio(F.col("done"), F.col("wanted"))).alias("completion"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, *, prefer_old: bool = False) -> DataFrame:
    """Rows by key, the last by `order` wins; of equals the new one. With prefer_old a key of old rows keeps its first
    one, and a key of new rows alone its first."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    by = [F.asc("_new"), F.asc_nulls_last(order)] if prefer_old else [F.desc_nulls_last(order), F.desc("_new")]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return both.withColumn("_place", place).where("_place = 1").drop("_place", "_new")


def membership(cohort: DataFrame, configs: DataFrame) -> DataFrame:
    """Cohort rows with the first config (by slug) whose id, handle or name key is the row's.
    cohort: (candidate_id, url); configs: (slug, channel_id, handle, name)."""
    from tidemark.functions.columns import channel_key

    keys = configs.select("slug", F.explode(F.array(F.concat(F.lit("channel:"), F.lower("channel_id")),
        F.concat(F.lit("handle:"), F.lower(F.regexp_replace("handle", "^@", ""))),
        F.concat(F.lit("last:"), F.lower("name")))).alias("key")).where("key is not null")
    first = keys.groupBy("key").agg(F.min("slug").alias("slug"))
    out = cohort.withColumn("key", channel_key(F.col("url"))).join(first, "key", "left")
    return out.withColumn("status", F.when(F.col("slug").isNull(), "missing_config").otherwise("ready"))

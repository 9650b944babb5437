"""Stored reports: one JSON document a channel, written from the sections of the channel metrics, and the metrics
read back out of such documents whatever their schema.

Documents are read as VARIANT: a section may be missing, empty, a list or its only object, numbers may be
texts, and reports of an older kind have three tiers. What cannot be read is undefined, and left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.channels import CONFLICT, long_metrics

# The sections and fields of a report that metrics are read from: the metric, the section, the
# field, and how the rows of the section make one number (`row`: the only row; `label=...`: the first row of
# that label).
FIELDS = [
    ("n_videos_in_scope", "$.channel_overview", "n_videos_in_scope", "row"),
    ("top_level_comments", "$.channel_overview", "n_comments_in_scope", "row"),
    ("top_level_commenters", "$.channel_overview", "n_commenters_in_scope", "row"),
    ("_views", "$.channel_overview", "total_views_in_scope", "row"),
    ("all_comments", "$.sentiment_source_summary", "n_scope_comments", "row"),
    ("commenter_network_density", "$.network_summary", "density", "row"),
    ("commenter_network_modularity", "$.network_summary", "modularity", "row"),
    ("commenter_network_communities", "$.network_summary", "n_communities", "row"),
    ("video_network_density", "$.video_network_summary", "density", "row"),
    ("video_network_modularity", "$.video_network_summary", "modularity", "row"),
    ("video_network_clusters", "$.video_network_summary", "n_video_clusters", "row"),
    ("rolling_return_rate_mean", "$.rolling_retention", "return_rate", "mean"),
    ("rolling_return_rate_latest", "$.rolling_retention", "return_rate", "last"),
    ("top_bridge_participation_mean", "$.bridge_actors", "participation_coefficient", "mean"),
    ("negative_rate", "$.sentiment_summary", "pct_comments", "sentiment_label=negative"),
    ("positive_rate", "$.sentiment_summary", "pct_comments", "sentiment_label=positive"),
    ("like_weighted_negative_rate", "$.sentiment_summary", "like_weighted_share", "sentiment_label=negative"),
    ("like_weighted_positive_rate", "$.sentiment_summary", "like_weighted_share", "sentiment_label=positive"),
    ("max_video_negative_rate", "$.sentiment_hotspots", "negative_rate", "max"),
    ("top5_hotspot_negative_rate_mean", "$.sentiment_hotspots", "negative_rate", "top5"),
    ("max_video_like_weighted_negative_rate", "$.sentiment_hotspots", "like_weighted_negative_rate", "max"),
    ("max_community_negative_rate", "$.community_sentiment_summary", "negative_rate", "max"),
    ("reply_share_all_comments", "$.commenter_deeper_analysis.reply_thread_overview", "reply_share_all_comments", "row"),
    ("pct_threads_with_replies", "$.commenter_deeper_analysis.reply_thread_overview", "pct_threads_with_replies", "row"),
    ("reply_negative_rate", "$.commenter_deeper_analysis.reply_sentiment_summary", "negative_rate", "is_top_level_label=reply"),
    *((f"max_video_{c}", "$.commenter_deeper_analysis.reply_conflict_video_summary", c, "max") for c in CONFLICT.values()),
    *((f"max_theme_{c}", "$.commenter_deeper_analysis.reply_conflict_theme_summary", c, "max") for c in list(CONFLICT.values())[:3]),
]
TIERS = {"core": "high", "regular": "mid", "returning": "low", "one_time": None}
WINDOWS = 4


def rows_of(doc: Column, path: str) -> Column:
    """The rows of a section: its list, or its only object, or none."""
    return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array_compact(F.array(F.try_variant_get(doc, path, "variant"))))


def number(row: Column, field: str) -> Column:
    """A field as a number; null for what is none."""
    return F.nanvl(F.try_variant_get(row, f"$.{field}", "double"), F.lit(None).cast("double"))


def numbers(rows: Column, field: str) -> Column:
    return F.filter(F.transform(rows, lambda r: number(r, field)), lambda x: x.isNotNull())


def _text(row: Column, field: str) -> Column:
    return F.try_variant_get(row, f"$.{field}", "string")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return ratio(total(values), F.size(values))


def _one(rows: Column, field: str, how: str) -> Column:
    if how == "row":
        return number(F.get(rows, F.lit(0)), field)
    if how == "last":
        return number(F.get(rows, F.size(rows) - 1), field)
    if "=" in how:
        label, value = how.split("=")
        return number(F.get(F.filter(rows, lambda r: _text(r, label) == value), F.lit(0)), field)
    found = numbers(rows, field)
    if how == "max":
        return F.array_max(found)
    return mean(F.slice(F.sort_array(found, asc=False), 1, 5) if how == "top5" else found)


def report_metrics(reports: DataFrame, text: str = "report", key: str = "channel") -> DataFrame:
    """(key, metric, value) of stored reports; a report that is no JSON has none."""
    paths = {path: f"_s{i}" for i, path in enumerate(dict.fromkeys(f[1] for f in FIELDS))}
    doc = reports.select(key, F.try_parse_json(text).alias("_doc"))
    d = F.col("_doc")
    out = doc.select(key, "_doc", *(rows_of(d, path).alias(name) for path, name in paths.items()), rows_of(d, "$.commenter_tiers").alias("_tiers"),
        rows_of(d, "$.continuity_sensitivity").alias("_kept"), rows_of(d, "$.community_summary").alias("_parts"))
    tier = lambda name: F.get(F.filter("_tiers", lambda r: _text(r, "activity_tier") == name), F.lit(0)) if name else None
    share = lambda name: F.coalesce(number(tier(name), "pct_commenters"), F.lit(0.0)) / 100 if name else F.lit(0.0)
    modern = {t: share(t) for t in TIERS}
    old = sum(modern.values(), F.lit(0.0)) == 0  # only reports of the older kind have none of the four
    four = F.filter("_kept", lambda r: F.floor(number(r, "n_windows")) == WINDOWS)
    comments = lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, r: a + number(r, "total_comments"))
    engaged = F.filter("_tiers", lambda r: _text(r, "activity_tier").isin("core", "regular", "high", "mid"))
    sizes = F.sort_array(F.transform(numbers(F.col("_parts"), "pct_nodes"), lambda x: x / 100), asc=False)
    some = lambda c: F.when(F.size("_sizes") > 0, c)
    out = out.select(key, *(_one(F.col(paths[path]), field, how).alias(metric) for metric, path, field, how in FIELDS),
        *(F.when(old, share(TIERS[t])).otherwise(modern[t]).alias(f"{t}_tier_commenter_share") for t in TIERS),
        ratio(comments(engaged), comments(F.col("_tiers"))).alias("core_regular_tier_comment_share"),
        number(F.coalesce(F.get(four, F.lit(0)), F.get("_kept", F.lit(0))), "weighted_return_rate").alias("continuity_return_rate_w4"),
        sizes.alias("_sizes"), d.isNotNull().alias("_read"))
    out = out.where("_read").withColumns({"largest_community_share": some(F.array_max("_sizes")), "top3_community_share": some(total(F.slice("_sizes", 1, 3))),
        "community_hhi": some(total(F.transform("_sizes", lambda x: x * x))),
        "core_regular_tier_commenter_share": F.col("core_tier_commenter_share") + F.col("regular_tier_commenter_share"),
        "low_tier_commenter_share": F.col("returning_tier_commenter_share") + F.col("one_time_tier_commenter_share"),
        "comments_per_video": ratio(F.col("top_level_comments"), F.col("n_videos_in_scope")),
        "commenters_per_video": ratio(F.col("top_level_commenters"), F.col("n_videos_in_scope")),
        "comments_per_1k_views": ratio(1000 * F.col("top_level_comments"), F.col("_views"))})
    same = {"high_tier_commenter_share": "core_tier_commenter_share", "mid_tier_commenter_share": "regular_tier_commenter_share",
        "high_mid_tier_commenter_share": "core_regular_tier_commenter_share", "high_mid_tier_comment_share": "core_regular_tier_comment_share"}
    out = out.withColumns({k: F.col(v) for k, v in same.items()})
    return long_metrics(out, [c for c in out.columns if c != key and not c.startswith("_")], key)


def _listed(section: DataFrame, name: str, fields: dict[str, Column], order: Column) -> DataFrame:
    """(channel, name): the section's rows as a list, in order."""
    row = F.struct(*(c.alias(k) for k, c in fields.items()))
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r")))), lambda x: x["r"])
    return section.groupBy("channel").agg(items.alias(name))


def _highest(section: DataFrame, measures: list[str], spots: int) -> DataFrame:
    """The `spots` videos of each channel of highest first measure, and those that hold the highest of the others, with
    their place `_i`; ties: the smaller id. Places are limited one by one, which Spark does before it shuffles."""
    out = None
    for at, measure in enumerate(measures):
        place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc_nulls_last(measure), "video_id"))
        best = section.withColumn("_i", place).where(F.col("_i") <= (1 if at else spots)).withColumn("_i", F.col("_i") + (F.lit(spots + at) if at else 0))
        out = best if out is None else out.unionByName(best)
    rest = [x for x in section.columns if x not in ("channel", "video_id")]
    return out.groupBy("channel", "video_id").agg(F.min("_i").alias("_i"), *(F.first(x).alias(x) for x in rest))


def report_documents(found: dict[str, DataFrame], *, spots: int = 100) -> DataFrame:
    """(channel, report): the sections of each channel as one JSON document. Lists of videos are the `spots` of the
    highest rate or score, and those that hold the highest of another measure: a document does not grow with the
    videos of its channel, but for one rate in 25 of them."""
    c = F.col
    totals = found["tiers"].groupBy("channel").agg(F.sum("n_commenters").alias("_n"), F.sum("total_comments").alias("_c"))
    tiers = found["tiers"].join(totals, "channel")
    overview = found["scope"].join(totals, "channel", "left").join(found["sentiment"], "channel", "left").join(found["replies"], "channel", "left")
    labels = F.array(*(F.struct(F.lit(x).alias("sentiment_label"), c(f"{x}_rate").alias("pct_comments"), c(f"like_weighted_{x}_rate").alias("like_weighted_share"))
        for x in ("negative", "positive")))
    one = lambda **fields: F.array(F.struct(*(x.alias(k) for k, x in fields.items())))
    base = overview.select("channel", one(n_videos_in_scope=c("n_videos_in_scope"), n_comments_in_scope=c("_c"), n_commenters_in_scope=c("_n"),
        total_views_in_scope=c("total_views")).alias("channel_overview"), one(n_scope_comments=c("all_comments")).alias("sentiment_source_summary"),
        labels.alias("sentiment_summary"), one(reply_share_all_comments=c("reply_share_all_comments"),
        pct_threads_with_replies=c("pct_threads_with_replies")).alias("reply_thread_overview"),
        one(is_top_level_label=F.lit("reply"), negative_rate=c("reply_negative_rate")).alias("reply_sentiment_summary"))
    hot = _highest(found["hotspots"], ["negative_rate", "like_weighted_negative_rate"], spots)
    fierce = _highest(found["conflict_videos"], list(CONFLICT.values()), spots)
    clash = {name: c(name) for name in CONFLICT.values()}
    parts = [
        _listed(tiers, "commenter_tiers", {"activity_tier": c("tier"), "pct_commenters": 100 * ratio(c("n_commenters"), c("_n")),
            "total_comments": c("total_comments")}, c("tier")),
        _listed(found["continuity"], "continuity_sensitivity", {"n_windows": c("n_windows"), "weighted_return_rate": c("weighted_return_rate")}, c("n_windows")),
        _listed(found["rolling"], "rolling_retention", {"return_rate": c("return_rate")}, c("cutoff")),
        _listed(found["network"], "network_summary", {"density": c("density"), "modularity": c("modularity"), "n_communities": c("communities")}, F.lit(0)),
        _listed(found["video_network"], "video_network_summary", {"density": c("density"), "modularity": c("modularity"),
            "n_video_clusters": c("communities")}, F.lit(0)),
        _listed(found["communities"], "community_summary", {"pct_nodes": 100 * c("share")}, -c("n")),
        _listed(found["bridges"], "bridge_actors", {"participation_coefficient": c("participation")}, c("place")),
        _listed(hot, "sentiment_hotspots", {"negative_rate": c("negative_rate"), "like_weighted_negative_rate": c("like_weighted_negative_rate")}, c("_i")),
        _listed(found["community_sentiment"], "community_sentiment_summary", {"negative_rate": c("negative_rate")}, c("community")),
        _listed(fierce, "reply_conflict_video_summary", clash, c("_i")),
        _listed(found["conflict_themes"], "reply_conflict_theme_summary", clash, c("theme")),
    ]
    out = base
    for part in parts:
        out = out.join(part, "channel", "left")
    deep = [x for x in out.columns if x.startswith("reply_")]
    plain = [x for x in out.columns if x not in ("channel", *deep)]
    whole = F.struct(F.struct(c("channel").alias("channel_id"), c("channel").alias("title")).alias("channel"), *plain, F.struct(*deep).alias("commenter_deeper_analysis"))
    return out.select("channel", F.to_json(whole).alias("report"))

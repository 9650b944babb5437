"""Metrics out of stored reports of any schema."""

import json
import math

import pytest

from tidemark.operators import reports


def metrics(spark, *docs):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    out = reports.report_metrics(spark.createDataFrame(rows, "run int, report string"), key="run").collect()
    return [{r.metric: r.value for r in out if r.run == i} for i in range(len(docs))]


FULL = {
    "channel_overview": [{"n_videos_in_scope": 10, "n_comments_in_scope": 200, "n_commenters_in_scope": 50, "total_views_in_scope": 4000}],
    "sentiment_source_summary": [{"n_scope_comments": 260}],
    "commenter_tiers": [{"activity_tier": "core", "pct_commenters": 10, "total_comments": 90}, {"activity_tier": "regular", "pct_commenters": 20, "total_comments": 60},
        {"activity_tier": "returning", "pct_commenters": 30, "total_comments": 30}, {"activity_tier": "one_time", "pct_commenters": 40, "total_comments": 20}],
    "continuity_sensitivity": [{"n_windows": 3, "weighted_return_rate": 0.9}, {"n_windows": 4, "weighted_return_rate": 0.5}],
    "rolling_retention": [{"return_rate": 0.2}, {"return_rate": None}, {"return_rate": 0.4}],
    "community_summary": [{"pct_nodes": p} for p in (10, 50, 25, 15)],
    "bridge_actors": [{"participation_coefficient": 0.5}, {"participation_coefficient": "0.7"}],
    "network_summary": {"density": 0.1, "modularity": 0.3, "n_communities": 4},
    "sentiment_summary": [{"sentiment_label": "positive", "pct_comments": 0.3, "like_weighted_share": 0.2}, {"sentiment_label": "negative", "pct_comments": 0.1}],
    "sentiment_hotspots": [{"negative_rate": r, "like_weighted_negative_rate": r / 2} for r in (0.1, 0.9, 0.5, 0.7, 0.3, 0.2)],
    "commenter_deeper_analysis": {"reply_thread_overview": [{"reply_share_all_comments": 0.4}], "reply_sentiment_summary": [{"is_top_level_label": "top_level",
        "negative_rate": 0.1}, {"is_top_level_label": "reply", "negative_rate": 0.6}], "reply_conflict_video_summary": [{"conflict_score": 2}, {"conflict_score": 5}]},
}


def test_all_sections(spark):
    got = metrics(spark, FULL)[0]
    want = {"n_videos_in_scope": 10, "comments_per_video": 20, "commenters_per_video": 5, "comments_per_1k_views": 50, "all_comments": 260,
        "core_tier_commenter_share": 0.1, "one_time_tier_commenter_share": 0.4, "core_regular_tier_commenter_share": 0.3, "low_tier_commenter_share": 0.7,
        "core_regular_tier_comment_share": 0.75, "continuity_return_rate_w4": 0.5, "rolling_return_rate_mean": 0.3, "rolling_return_rate_latest": 0.4,
        "largest_community_share": 0.5, "top3_community_share": 0.9, "community_hhi": 0.345, "top_bridge_participation_mean": 0.6,
        "commenter_network_density": 0.1, "negative_rate": 0.1, "positive_rate": 0.3, "like_weighted_positive_rate": 0.2, "max_video_negative_rate": 0.9,
        "top5_hotspot_negative_rate_mean": 0.52, "max_video_like_weighted_negative_rate": 0.45, "reply_share_all_comments": 0.4, "reply_negative_rate": 0.6,
        "max_video_conflict_score": 5}
    assert {k: got.get(k) for k in want} == pytest.approx(want)
    assert "like_weighted_negative_rate" not in got and "pct_threads_with_replies" not in got and "max_theme_conflict_score" not in got


def test_schemas_drift(spark):
    legacy = {"commenter_tiers": [{"activity_tier": "high", "pct_commenters": 5, "total_comments": 60}, {"activity_tier": "mid", "pct_commenters": "15",
        "total_comments": 20}, {"activity_tier": "low", "pct_commenters": 80, "total_comments": 20}]}
    other = {"channel_overview": {"n_videos_in_scope": "7", "n_comments_in_scope": "many", "n_commenters_in_scope": ""}, "rolling_retention": [],
        "community_summary": None, "bridge_actors": "none", "continuity_sensitivity": [{"n_windows": 6, "weighted_return_rate": 0.25}], "commenter_tiers": [],
        "sentiment_hotspots": [5, "x", {"negative_rate": True}, {"negative_rate": 0.5}], "rolling": [1]}
    old, odd, empty, junk, null, listed = metrics(spark, legacy, other, {}, "{not json", None, [1])
    assert (old["core_tier_commenter_share"], old["regular_tier_commenter_share"], old["returning_tier_commenter_share"],
        old["one_time_tier_commenter_share"]) == (0.05, 0.15, 0.8, 0)
    assert old["high_mid_tier_comment_share"] == 0.8 and old["low_tier_commenter_share"] == 0.8
    assert odd["n_videos_in_scope"] == 7 and "top_level_comments" not in odd and "rolling_return_rate_latest" not in odd
    assert odd["continuity_return_rate_w4"] == 0.25 and odd["max_video_negative_rate"] >= 0.5 and "largest_community_share" not in odd
    assert junk == {} == null and set(empty) == set(listed) and all(v == 0 and not math.isnan(v) for v in empty.values())


def test_documents_do_not_grow_with_videos(spark, small):
    """Of its videos a document holds those that its metrics need, and the metrics are those of all videos."""
    from tidemark.plans import registry
    from tidemark.sources.views import Views

    found = registry._sections(Views(spark, small))
    few = reports.report_documents(found, spots=5).cache()
    for r in few.collect():
        doc = json.loads(r.report)
        assert len(doc["commenter_deeper_analysis"]["reply_conflict_video_summary"]) <= 5 + 3 and len(doc["sentiment_hotspots"]) <= 5 + 1
    values = lambda docs: sorted(tuple(r) for r in reports.report_metrics(docs).collect())
    assert values(few) == values(reports.report_documents(found, spots=10**6))

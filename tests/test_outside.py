"""Outside events on frames built by hand: every branch of the predicates, clusters, windows and decay."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import events

DAY = datetime.date
POSTS = "post_uid string, ts timestamp, day date, title string, topic string, engagement double, source string, hint boolean, semantic boolean, relevant boolean, noise boolean"


def post(uid, day, topic, engagement=0.0, source="forum_a", hint=False, semantic=False, relevant=True, noise=False):
    return (uid, datetime.datetime.combine(day, datetime.time(9)), day, f"t {uid}", topic, engagement, source, hint, semantic, relevant, noise)


def test_topics_and_noise(spark):
    texts = ["填問卷 please", "He said an APOLOGY", "新主持", "統戰", "so Cringe", "造假", "求推薦", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(events.heuristic_topic(F.col("t"))).collect()]
    assert got == ["survey_or_spam", "controversy_or_apology", "staff_or_host_change", "political_or_social_controversy",
        "content_quality_criticism", "content_authenticity_question", "recommendation_or_general_mentions", "general", "general"]
    assert [r[0] for r in spark.createDataFrame([("這是表單",), ("x",)], "t string").select(events.noise(F.col("t"))).collect()] == [True, False]


def test_enriched_posts(spark):
    posts = spark.createDataFrame([("a", "道歉", True), ("b", "抽1000", True), ("c", "x", False), ("d", "x", True)],
        "post_uid string, text string, alias_hit boolean")
    labels = spark.createDataFrame([("a", "1", "no", "true", " ", "business_or_product", 1),
        ("d", "yes", "y", "t", "own topic", "other", 1), ("d", "no", "no", "no", "late", "other", 2)],
        "post_uid string, is_relevant string, is_noise string, is_external_event_candidate string, topic_label string, event_type string, seq int")
    last = events.semantic_labels(labels, order="seq")
    assert {r.post_uid: r.topic_label for r in last.collect()} == {"a": " ", "d": "late"}
    got = {r.post_uid: (r.relevant, r.noise, r.topic, r.hint, r.semantic) for r in events.enriched(posts, last, require_alias=True).collect()}
    assert got == {
        "a": (True, False, "business_or_product", True, True), "b": (False, True, "survey_or_spam", False, False),
        "c": (False, False, "general", False, False), "d": (False, False, "late", False, True),
    }
    plain = {r.post_uid: r.relevant for r in events.enriched(posts).collect()}
    assert plain == {"a": True, "b": False, "c": True, "d": True}


def test_candidate_days(spark):
    """One day for each way to be a candidate, and those that just miss."""
    d = lambda i: DAY(2024, 1, i)
    rows = [post("h", d(1), "general", hint=True), post("s1", d(2), "general"), post("s2", d(2), "general", source="forum_b"),
        post("e", d(3), "general", 10.0), post("u", d(4), "general", 9.0)]
    rows += [post(f"w{i}", d(5), "general") for i in range(3)] + [post(f"x{i}", d(6), "general") for i in range(4)] + [post("y", d(7),
        "topic")] + [post(f"z{i}", d(8), "topic") for i in range(2)]
    rows += [post("n", d(9), "topic", 99.0, noise=True), post("i", d(9), "topic", 99.0, relevant=False)]
    daily = events.daily_posts(spark.createDataFrame(rows, POSTS))
    assert sorted(r.day.day for r in daily.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert sorted(r.day.day for r in events.candidate_days(daily).collect()) == [1, 2, 3, 6, 8]


def test_clusters(spark):
    """A gap of three days merges and of four does not; topics part clusters unless they are merged; a day's
    commonest topic decides (ties by name)."""
    d = lambda i: DAY(2024, 1, i)
    rows = [post(f"a{i}{k}", d(i), "a") for i in (1, 4, 8) for k in range(2)] + [post(f"b{k}", d(5), "b", 20.0) for k in range(2)] + [post("tie", d(1), "c")]
    posts = spark.createDataFrame(rows, POSTS)
    got = events.event_clusters(posts).orderBy("event_id").collect()
    assert [(r.event_id, r.event_topic, r.event_start.day, r.event_end.day, r.n_posts) for r in got] == [("external_event_001", "a", 1, 4,
        4), ("external_event_002", "b", 5, 5, 2), ("external_event_003", "a", 8, 8, 2)]
    assert got[0].post_uids == "a10;a11;a40;a41" and got[0].top_titles.startswith("t a10 || t a11")
    one = events.event_clusters(posts, events.Settings(merge_cross_topic=True)).collect()
    assert [(r.event_start.day, r.event_end.day, r.n_posts, r.event_topic) for r in one] == [(1, 8, 9, "b")]
    assert events.event_clusters(posts, events.Settings(merge_gap_days=0)).count() == 4
    assert events.event_clusters(posts.limit(0)).count() == 0


def test_cluster_with_too_few_posts_of_its_topic(spark):
    rows = [post("a", DAY(2024, 1, 1), "a"), post("b", DAY(2024, 1, 1), "b")]
    row = events.event_clusters(spark.createDataFrame(rows, POSTS)).first()
    assert (row.event_topic, row.n_posts) == ("mixed_external_discussion", 2)


def test_votes(spark):
    """Weak topics lose to any other, spam has no vote, ties go by priority, unlisted topics stand between."""
    rows = [("1", "general", 1e6, False, False), ("1", "x", 0.0, False, False), ("2", "politics_or_culture", 0.0, False, False),
        ("2", "unlisted", 0.0, False, False), ("3", "unlisted", 0.0, False, False), ("3", "zzz", 0.0, False, False)]
    rows += [("4", "survey_or_spam", 99.0, True, True), ("4", "general", 0.0, False, False), ("5", "x", 1.0, False, False),
        ("5", "y", 0.0, True, False), ("6", "x", 10.0, False, False), ("6", "y", 0.0, False, True)]
    got = {r.event_id: (r.topic, r.votes) for r in events.topic_votes(spark.createDataFrame(rows,
        "event_id string, topic string, engagement double, hint boolean, semantic boolean"), "event_id").collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "x", "2": "politics_or_culture", "3": "zzz", "4": "general", "5": "y", "6": "y"}
    assert got["5"][1] == 26.0 and got["6"][1] == 6.0


def comments_of(spark, rows):
    return spark.createDataFrame([(datetime.datetime.fromisoformat(ts), label, likes, actor, video) for ts, label, likes, actor,
        video in rows], "ts timestamp, label string, like_count bigint, actor_id bigint, video_id bigint")


EVENT = "event_id int, event_start date"


def test_windows_are_half_open(spark):
    """Event of 2024-07-01: the baseline begins 118 days before, pre 28 days before, post ends 28 days after."""
    at = ["2024-03-04 23:59:59", "2024-03-05 00:00:00", "2024-06-02 23:59:59", "2024-06-03 00:00:00", "2024-06-30 23:59:59",
        "2024-07-01 00:00:00", "2024-07-28 23:59:59", "2024-07-29 00:00:00", "2024-08-25 23:59:59", "2024-08-26 00:00:00"]
    rows = comments_of(spark, [(t, "negative" if i % 2 else "neutral", i, i, i) for i, t in enumerate(at)])
    event = spark.createDataFrame([(1, DAY(2024, 7, 1)), (2, DAY(2030, 1, 1))], EVENT)
    held = {r.ts.isoformat(" "): r.window for r in events.in_windows(rows, event).collect()}
    assert held == dict(zip(at[1:9], ["baseline"] * 2 + ["pre"] * 2 + ["post"] * 2 + ["follow"] * 2))
    one, none = events.event_windows(rows, event).orderBy("event_id").collect()
    assert (one.baseline_n, one.pre_n, one.post_n, one.post_negative_rate, one.delta_pp) == (2, 2, 2, 0.5, 0.0)
    assert (none.baseline_n, none.post_n, none.post_negative_rate, none.baseline_z) == (0, 0, None, None)


def half_life_of(spark, base, days):
    """days: (day after the event, comments, negative ones)."""
    start = datetime.datetime(2024, 7, 1)
    rows = [((start - datetime.timedelta(days=60)).isoformat(" "), label, 0, 1, 1) for label in base]
    for day, n, neg in days:
        rows += [((start + datetime.timedelta(days=day)).isoformat(" "), "negative" if i < neg else "neutral", 0, 1, 1) for i in range(n)]
    row = events.half_life(comments_of(spark, rows), spark.createDataFrame([(1, DAY(2024, 7, 1))], EVENT)).first()
    return row.half_life_days, row.observed


def test_half_life(spark):
    base = ["negative"] + ["neutral"] * 9  # a rate of 0.1
    assert half_life_of(spark, base, [(0, 10, 9), (5, 10, 5), (6, 10, 1), (7, 10, 1), (9, 10, 1)]) == (6, True)
    assert half_life_of(spark, base, [(0, 10, 9), (5, 10, 9)]) == (28, False)
    assert half_life_of(spark, base, [(0, 10, 1)]) == (None, False)
    assert half_life_of(spark, base, [(10, 10, 5), (11, 10, 0)]) == (11, True)  # no early days: the first with comments
    assert half_life_of(spark, base, []) == (None, False) and half_life_of(spark, [], [(0, 10, 9)]) == (None, False)


def test_p_values(spark):
    zs = [0.0, 1e-6, -0.5, 1.0, 1.959964, -3.0, 6.0, None]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(fn.two_sided_p(F.col("z"))).collect()
    for z, (p,) in zip(zs, got):
        assert p is None if z is None else p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1.5e-7, abs=1e-15)


def test_summary_of_labels_and_words(spark):
    posts = spark.createDataFrame([post("a", DAY(2024, 1, 1), "x", semantic=True), post("b", DAY(2024, 1, 2), "x", noise=True)], POSTS)
    daily = events.candidate_days(events.daily_posts(posts))
    row = events.external_summary(posts, daily, events.event_clusters(posts)).first()
    assert (row.n_posts, row.n_semantic, row.n_noise, row.n_days, row.semantics_source) == (2, 1, 1, 2, "external_post_labels")

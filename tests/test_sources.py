import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import matching, model_output
from tidemark.operators import cohort, state
from tidemark.sources import loaders
from tidemark.sources.keyed import KeyedTable
from tidemark.sources.views import read_table
from tidemark.streaming import rates


def test_config():
    text = "project_name: 'A b'  # note\nchannel_id: UC1\ninclude_replies: false\nanalysis:\n  core_coverage: 0.05\n  windows: 4\n  none: null\noutputs:\n  run_slug: \"x\"\nlast: 3\n"
    assert loaders.parse_config(text) == {"project_name": "A b", "channel_id": "UC1", "include_replies": False,
        "analysis": {"core_coverage": 0.05, "windows": 4, "none": None}, "outputs": {"run_slug": "x"}, "last": 3}
    assert loaders.slug("Ab  C_d!") == "ab-c-d"


def test_scope_of_videos_and_comments(spark):
    videos = spark.createDataFrame([("v1", "c", "2024-01-01 00:00:00", "PT5M"), ("v2", "c", "2024-02-01 00:00:00", "PT59S"),
        ("v3", "c", "2025-01-01 00:00:00", "PT9M"), ("v4", "d", "2024-01-01 00:00:00", "PT9M")],
        "video_id string, owner_channel_id string, published_at string, duration string").withColumn("published_at", F.col("published_at").cast("timestamp"))
    scope = loaders.Scope("c", "2024-01-01", "2025-01-01")
    kept = loaders.load_videos(videos, scope)
    assert [r.video_id for r in kept.collect()] == ["v1"]
    comments = spark.createDataFrame([("x", "v1", "a", 1, 2), ("y", "v1", None, 1, 2), ("z", "v1", "b", 0, None), ("w", "v2", "a", 1, 0)],
        "comment_id string, video_id string, author_actor_id string, is_top_level int, like_count long")
    actors = spark.createDataFrame([("a", "Ann")], "actor_id string, latest_display_name string")
    assert [(r.comment_id, r.name) for r in loaders.load_comments(comments, kept, actors, scope).collect()] == [("x", "Ann")]
    every = loaders.load_comments(comments, kept, actors, loaders.Scope("c", include_replies=True)).orderBy("comment_id").collect()
    assert [(r.comment_id, r.name, r.like_count) for r in every] == [("x", "Ann", 2), ("z", None, 0)]
    labels = spark.createDataFrame([("x", "Positive", "false", "0.9"), ("z", "??", None, "no"), ("w", "negative", "True", "1")],
        "comment_id string, sentiment_label string, sentiment_parse_error string, score_pos string")
    got = {r.comment_id: (r.label, r.score_pos, r.weight) for r in loaders.load_sentiment(labels, comments).collect()}
    assert got == {"x": ("positive", 0.9, 3), "z": ("neutral", None, 1)}
    with pytest.raises(ValueError):
        loaders.load_sentiment(labels.drop("sentiment_parse_error"), comments)


def test_channels(spark):
    channels = spark.createDataFrame([("c2", "B", "@Some_x"), ("c1", "some_x", None), ("c3", "x", "@somexx")],
        "channel_id string, title string, custom_url string")
    assert loaders.resolve_channel(channels, "@Some_X").first().channel_id == "c2"
    assert loaders.resolve_channel(channels, "c3").first().channel_id == "c3"
    assert loaders.resolve_channel(channels, "zz").count() == 0


def test_post_dates(spark):
    rows = spark.createDataFrame([("時間 Sun Jan 14 12:34:56 2024\nx",), ("at 24/01/14 12:34 x",), ("24/13/40 12:34",), (None,)],
        "t string").select(loaders.header_date(F.col("t")).alias("h"), loaders.short_date(F.col("t")).alias("s")).collect()
    assert rows[0].h == datetime.datetime(2024, 1, 14, 12, 34, 56) and rows[1].s == datetime.datetime(2024, 1, 14, 12, 34)
    assert rows[2].s is None and rows[3].h is None and rows[1].h is None
    at = datetime.datetime
    text = spark.createDataFrame([("12 月 31 日 09:05",), ("none",)], "t string").select(loaders.undated(F.col("t")).alias("u")).collect()
    assert tuple(text[0].u) == (12, 31, 9, 5) and text[1].u is None
    posts = [(1, at(2019, 5, 1), None), (2, None, (12, 31, 9, 5)), (3, at(2020, 2, 1), None), (4, None, (2, 29, 0, 0)), (5, None, None),
        (9, None, (1, 1, 0, 0)), (10, at(2018, 6, 1), None)]
    df = spark.createDataFrame(posts, "id long, ts timestamp, parts struct<month: int, day: int, hour: int, minute: int>").repartition(3)
    got = {r.id: (r.ts, r.date_quality) for r in loaders.with_inferred_dates(df).collect()}
    # ids 4 and 9 have no year between their bounds: the nearest to any dated post
    assert got == {1: (at(2019, 5, 1), "explicit"), 2: (at(2019, 12, 31, 9, 5), "inferred"), 3: (at(2020, 2, 1), "explicit"),
        4: (at(2020, 2, 29), "inferred"), 5: (None, "explicit"), 9: (at(2020, 1, 1), "inferred"), 10: (at(2018, 6, 1), "explicit")}


def test_posts(spark):
    a = spark.createDataFrame([("t", "u1", "時間 Sun Jan 14 12:34:56 2024", 1, 2, 3), ("t", "u1", "時間 Mon Jan 15 12:34:56 2024", 1, 0, 0),
        ("t", "u2", "none", 1, 1, 1)], "title string, url string, body string, pushes int, boos int, comment_count int")
    b = spark.createDataFrame([("9", "u", "t Ab  c", "text", 5, None, "24/01/14 12:34")],
        "id string, url string, title string, content string, like_count int, comment_count int, created_at string")
    got = {r.post_uid: (r.day.day, r.engagement, r.alias_hit) for r in loaders.aliased(loaders.load_posts(a, b), ["AB C"]).collect()}
    assert got == {"forum_a:u1": (15, 1, False), "forum_b:9": (14, 5, True)}


def test_sinks_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a|b"), (2, float("nan"), None)], "i int, x double, s string")
    loaders.write_csv(df, str(tmp_path / "t.csv"))
    loaders.write_json(df, str(tmp_path / "t.json"))
    loaders.write_report(df, str(tmp_path / "t.md"))
    assert read_table(spark, str(tmp_path), "t.csv").count() == 2
    assert {r.i: r.x for r in read_table(spark, str(tmp_path), "t.json").collect()} == {1: 0.5, 2: None}
    assert "| i | x | s |" in "".join(p.read_text() for p in (tmp_path / "t.md").glob("part*"))


REPAIR = [('{"a": 1}', {"a": 1}), ('note {"a": {"b": 2}} tail', {"a": {"b": 2}}), ('```json\n{"a": "x"', {"a": "x"}),
    ('{"a": 1, "b": tru', {"a": 1}), ('{"a": [1, 2', {"a": [1, 2]}), ('<think>{"z":1}</think>{"a": "q', {"a": "q"}), ("junk", None),
    ("", None), (None, None), ("[1]", None), ('{"a": "say \\"hi', {"a": 'say "hi'})]


@pytest.mark.parametrize("text,want", REPAIR)
def test_repair(text, want):
    got = model_output.repaired(text)
    assert (json.loads(got) if got else None) == want


def test_model_labels(spark):
    raw = spark.createDataFrame([(1, '{"label": "Positive", "score_neg": 1, "score_neu": 1, "score_pos": 2, "toxicity": 7, "emotion_tags": ["Joy", "joy "]}'),
        (2, "nothing"), (3, '{"label": "angry", "confidence": 0.5'), (4, None)],
        "i int, raw string")
    got = {r.i: r for r in model_output.sentiment_labels(raw).collect()}
    assert (got[1].label, got[1].score_pos, got[1].toxicity, got[1].emotion_tags, got[1].parse_error) == ("positive", 0.5, 1.0, "joy", False)
    assert (got[2].label, got[2].score_neg, got[2].parse_error) == ("neutral", 0.25, True) and got[4].parse_error
    assert (got[3].label, got[3].score_neu, got[3].confidence) == ("neutral", 0.8, 0.5)


def test_matching(spark):
    rows = spark.createDataFrame([(1, "Blue Bird", "blue bird!", True, 10, 2), (1, "Blue Bird", "bird", False, 0, 1),
        (2, "頻道 one", "頻道", None, None, 1), (3, "zzz", "other", False, 0, 1)],
        "candidate_id int, name string, title string, verified boolean, subscribers int, rank int")
    got = {r.candidate_id: (r.title, r.score, r.confidence) for r in matching.best_matches(rows).collect()}
    assert got == {1: ("blue bird!", 100 + 45 + 40 + 15 + 5 - 2, "high"), 2: ("頻道", 45 + 20 - 1, "medium"), 3: ("other", -1, "low")}
    assert spark.createDataFrame([("Team熱狗 Live/TV",)],
        "s string").select(matching.keyword_variants(F.col("s"))).first()[0] == ["team熱狗 live/tv", "team熱狗", "live", "tv", "熱狗", "team"]


def test_upsert_and_completion(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, at int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, at int, x string")
    assert sorted((r.k, r.x) for r in cohort.upsert(old, new, "k", "at").collect()) == [(1, "c"), (2, "b"), (3, "e")]
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, "true"), (1, "no"), (2, "yes"), (9, "no")], "k int, bad string")
    row = state.completion_by(wanted, done, "k", error="bad").first()
    assert (row.expected, row.completed, row.failed, row.remaining) == (3, 1, 1, 2)
    assert sorted(r.k for r in state.remaining(wanted, done, "k", error="bad").collect()) == [2, 3]
    assert state.final_estimate(100, 1000) == (pytest.approx(17.4), pytest.approx(54.2))


def test_streams_agree_with_tables(spark, small, tmp_path):
    from tidemark.sources.views import Views

    posts = Views(spark, small).posts.select("event_id", "ts", "topic", "engagement", "author")
    posts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, build in (("daily", rates.daily_counts), ("sessions", rates.sessions)):
        q = build(stream, late="60 days").writeStream.outputMode("append" if name == "sessions" else "update").format("memory").queryName(name).option("checkpointLocation",
            str(tmp_path / f"cp-{name}")).start()
        q.processAllAvailable()
        q.stop()
    got = {(r.day, r.topic): r.n_posts for r in spark.sql("select day, topic, max(n_posts) as n_posts from daily group by 1, 2").collect()}
    assert got == {(r.day, r.topic): r.n_posts for r in rates.daily_counts(posts).collect()}
    twice = stream.unionByName(stream)
    q = rates.deduplicated(twice, late="60 days").writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation",
        str(tmp_path / "cp-once")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == posts.count()
    q = stream.writeStream.foreachBatch(rates.upsert_sink(str(tmp_path / "out"), "event_id", "ts")).option("checkpointLocation",
        str(tmp_path / "cp-up")).start()
    q.processAllAvailable()
    q.stop()
    assert KeyedTable(spark, str(tmp_path / "out")).read().count() == posts.count()

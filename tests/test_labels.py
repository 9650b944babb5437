"""Model outputs made labels, themes of videos, aspects of texts, cohort lookups and shown values."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.functions import model_output
from tidemark.operators import activity, aspects, cohort, dashboard, themes
from tidemark.sources import loaders


def test_video_labels(spark):
    raw = [
        (1, 'note {"primary_theme": "food_culture", "secondary_themes": ["city_lifestyle", "food_culture", "nope"], "format": "food_review", "entities": ["A  b", ""], "confidence": 1.7}'),
        (2, '{"primary_theme": "nope", "secondary_themes": "travel_exploration|x", "setting": " japan "'),
        (3, "no object"),
    ]
    got = {r.i: r for r in model_output.video_labels(spark.createDataFrame(raw, "i int, raw string")).collect()}
    assert (got[1].primary_theme, got[1].theme_labels, got[1].format, got[1].entities, got[1].theme_confidence) == ("food_culture",
        "food_culture;city_lifestyle", "food_review", "A b", 1.0)
    assert (got[2].primary_theme, got[2].theme_labels, got[2].setting, got[2].theme_parse_error) == ("other", "travel_exploration", "japan", False)
    assert (got[3].theme_labels, got[3].theme_confidence, got[3].theme_parse_error) == ("other", 0.35, True)


def test_post_labels(spark):
    raw = [(1, '{"is_relevant": true, "is_noise": "no", "is_external_event_candidate": 1, "event_type": "other", "stance": "critical"}'),
        (2, '{"is_relevant": true, "is_noise": true, "topic_label": "t  t"}'), (3, "")]
    got = {r.i: r for r in model_output.post_labels(spark.createDataFrame(raw, "i int, raw string")).collect()}
    assert (got[1].is_relevant, got[1].is_external_event_candidate, got[1].topic_label, got[1].stance, got[1].target) == (True, True,
        "other", "critical", "unclear")
    assert (got[2].is_relevant, got[2].is_noise, got[2].topic_label, got[2].event_type) == (False, True, "t t", "none")
    assert got[3].semantic_parse_error and got[3].semantic_confidence == 0.35


def test_aspect_labels(spark):
    item = '{"aspect": "%s", "sentiment": "%s", "severity": %s, "confidence": %s}'
    raw = [
        (1, '{"aspects": [' + item % ("host_persona", "negative", 9, 0.5) + ", " + item % ("nope", "x", 1, 0.25) + '], "primary_aspect": "host_persona"}'),
        (2, "text " + item % ("pacing_editing", "mixed", 2, 0.75) + " {{{ broken"),
        (3, "nothing"),
    ]
    got = {r.i: r for r in model_output.aspect_labels(spark.createDataFrame(raw, "i int, raw string")).collect()}
    assert (got[1].primary_aspect, got[1].aspect_labels, got[1].aspect_severities, got[1].aspect_confidences) == ("host_persona",
        "host_persona;unclear", "host_persona=3;unclear=1", "host_persona=0.50;unclear=0.25")
    assert (got[2].aspect_sentiments, got[2].absa_repair_method, got[2].absa_parse_error) == ("pacing_editing=mixed", "field_salvage", False)
    assert (got[3].aspect_labels, got[3].absa_parse_error) == ("unclear", True)
    again = model_output.repair_outputs(spark.createDataFrame([(7, raw[1][1], "old")],
        "unit_id int, absa_raw string, aspect_labels string"), model_output.aspect_labels, "absa_raw", "unit_id")
    assert again.first().aspect_labels == "pacing_editing"


def test_themes_of_models_and_words(spark):
    videos = spark.createDataFrame([(1, "food trip"), (2, "x"), (3, "y")], "video_id long, title string")
    labels = spark.createDataFrame([(1, 1, "food_culture", "a"), (1, 2, "product_review", "b"), (9, 1, "food_culture", "c")],
        "video_id long, seq int, primary_theme string, secondary_themes string")
    got = {r.video_id: (r.primary_theme, r.theme_labels, r.theme_source) for r in themes.label_videos(videos, F.col("title"), labels).collect()}
    assert got == {1: ("product_review", "product_review", "model"), 2: ("other", "other", "keyword"), 3: ("other", "other", "keyword")}
    assert {r.video_id: r.primary_theme for r in themes.label_videos(videos, F.col("title")).collect()}[1] == "food_culture"
    raw = spark.createDataFrame([("food_culture, nope|city_lifestyle;food_culture",), (None,), ("",)], "t string")
    assert [r[0] for r in raw.select(themes.clean_theme_labels(F.col("t"))).collect()] == ["food_culture;city_lifestyle", "other", "other"]


def test_aspect_keywords_and_units(spark):
    docs = spark.createDataFrame([(1, "業配 FAKE", "neutral"), (2, "hello", "negative"), (3, None, "positive"), (4, "hello", None)],
        "doc_id int, text string, label string")
    got = {s: sorted(r.doc_id for r in aspects.comment_units(docs, s).collect()) for s in aspects.SCOPES}
    assert got == {"negative": [2], "positive": [3], "keyword": [1], "negative_or_keyword": [1, 2], "all": [1, 2, 3, 4]}
    assert aspects.comment_units(docs, "keyword").first().aspect_keyword_hits == "commercial_sponsorship;authenticity_fabrication"
    with pytest.raises(ValueError):
        aspects.comment_units(docs, "some")
    units = spark.createDataFrame([(1, "a;b;a", "a=x;b=negative;b=positive", "b=2;a=no", "a=0.5", 1), (2, None, None, None, None, None)],
        "unit_id int, aspect_labels string, aspect_sentiments string, aspect_severities string, aspect_confidences string, like_count long")
    rows = sorted((r.unit_id, r.aspect, r.sentiment, r.severity, r.confidence) for r in aspects.aspect_rows(units).collect())
    assert rows == [(1, "a", "x", 0.0, 0.5), (1, "b", "positive", 2.0, 0.0), (2, "unclear", "unclear", 0.0, 0.0)]


def test_archetypes_reach_every_rule(spark):
    names = list(cohort.INDICES)
    cases = {"high_engagement_high_risk": (70, 0, 0, 70, 0, 0), "steady_discussion": (70, 60, 0, 10, 0, 0),
        "core_circle": (50, 65, 0, 0, 65, 0), "expandable_portfolio": (50, 0, 0, 0, 0, 65), "quiet_potential": (44, 0, 65, 0, 0, 0),
        "low_participation": (39, 39, 0, 0, 0, 0), "balanced": (50, 50, 50, 50, 50, 50)}
    rows = [(case, n, float(x)) for case, scores in cases.items() for n, x in zip(names, scores) if x]
    got = {r.channel: r.archetype for r in cohort.archetypes(spark.createDataFrame(rows, "channel string, index_name string, score double")).collect()}
    assert got == {c: c for c in cases}
    bands = spark.createDataFrame([(x,) for x in (None, 80.0, 65.0, 40.0, 25.0, 24.9)], "s double").select(cohort.score_band(F.col("s"))).collect()
    assert [r[0] for r in bands] == ["unknown", "very_high", "high", "middle", "low", "very_low"]


def test_membership_and_lookup(spark):
    rows = spark.createDataFrame([("1", "One", "https://x.test/channel/UC1?a=1", "O"), ("2", "Two", "https://x.test/@Two/", "O"),
        ("3", "Three", "https://x.test/three", "X"), ("4", "Four", "https://x.test/none", "O")],
        "candidate_id string, channel_name string, url string, status string")
    kept = loaders.load_cohort(rows, status="status")
    configs = spark.createDataFrame([("b", "UC1", None, None), ("a", "uc1", None, None), ("two", None, "@two", "T")],
        "slug string, channel_id string, handle string, name string")
    got = {r.candidate_id: (r.slug, r.status) for r in cohort.membership(kept.drop("status"), configs).collect()}
    assert got == {"1": ("a", "ready"), "2": ("two", "ready"), "4": (None, "missing_config")}
    with pytest.raises(ValueError):
        loaders.load_cohort(rows.drop("url"), status="status")
    runs = spark.createDataFrame([("UC1", "runs/one", "One"), ("UC2", "x/two", "Two"), ("UC3", None, None)],
        "channel_id string, run_dir string, run_channel_title string")
    ids = lambda **k: sorted(r.channel_id for r in dashboard.channel_rows(runs, **k).collect())
    assert (ids(channel_id="UC1"), ids(slug="two"), ids(title="One", slug="two"), ids()) == (["UC1"], ["UC2"], ["UC1", "UC2"], [])


def test_shown_values(spark):
    cells = spark.createDataFrame([(None,), (0.0,), (0.125,), (-0.5,), (12.345,), (1234567.0,)], "x double")
    shown = [tuple(r) for r in cells.select(fn.shown_number(F.col("x")), fn.shown_decimal(F.col("x")), fn.shown_rate(F.col("x"))).collect()]
    assert shown == [("-", "-", "-"), ("0", "0.000", "0.0%"), ("0", "0.125", "12.5%"), ("-0", "-0.500", "-50.0%"),
        ("12", "12.345", "12.3%"), ("1,234,567", "1234567.000", "1234567.0%")]
    spans = spark.createDataFrame([(0, 0), (40, 40), (40, 100), (5000, 7500), (5400, 7199)],
        "a int, b int").select(fn.shown_range(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in spans] == ["0m", "40s", "40s to 2m", "83m to 2h 05m", "1h 30m to 2h 00m"]
    items = spark.createDataFrame([("a b (1,200); c; (x) d (no); ",), (None,)], "t string").select(fn.ranked_items(F.col("t"))).collect()
    assert [tuple(x) for x in items[0][0]] == [("a b", 1200.0), ("c", None), ("(x) d", None)] and items[1][0] == []
    assert [r[0] for r in spark.createDataFrame([(70.0,), (40.0,), (None,), (1.0,)],
        "p double").select(fn.rank_band(F.col("p"))).collect()] == ["high", "middle", "middle", "low"]
    assert spark.createDataFrame([("a  b\ncd e",)], "t string").select(fn.compact(F.col("t"), 6)).first()[0] == "a b c…"


def test_config_and_files(spark, tmp_path):
    text = "project_name: P q\nchannel_handle: '@Han'\ninclude_replies: true\nanalysis:\n  core_coverage: 0.1\nexternal_analysis:\n  sources: forum_a;forum_b\n  channel_aliases: Han, Other"
    c = loaders.load_config(text)
    assert (c.scope.channel_id, c.scope.include_replies, c.scope.exclude_shorts, c.analysis, c.run_slug, c.sources, c.aliases) == ("@Han",
        True, True, {"core_coverage": 0.1}, "p-q", ("forum_a", "forum_b"), ("Han", "Other"))
    for bad in ("channel_id: x", "project_name: x", "project_name: x\nchannel_id: y\nexternal_analysis:\n  sources: nope",
            "project_name: x\nchannel_id: y\nanalysis:\n  a: true"):
        with pytest.raises(ValueError):
            loaders.load_config(bad)
    assert loaders.source_mismatch({"metadata": {"channel_id": "a"}}, "b") and not loaders.source_mismatch({}, "b") and loaders.empty_posts(spark).count() == 0
    (tmp_path / "f").write_bytes(b"abc")
    loaders.verify_checksum(str(tmp_path / "f"), loaders.sha256_of(str(tmp_path / "f")).upper())
    with pytest.raises(ValueError):
        loaders.verify_checksum(str(tmp_path / "f"), "00")
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double")
    assert loaders.report_payload({"t": df.orderBy("i")}, rows=1) == {"t": [{"i": 1, "x": None}]}
    rows, n = loaders.page(df, 0)
    assert rows.count() == 1 and n == 2
    paths = loaders.write_outputs({"t": df}, str(tmp_path))
    assert spark.read.option("header", "true").csv(paths[0]).count() == 2
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "report.json").write_text('{"channel":\n {"channel_id": "c"}}')
    assert loaders.read_reports(spark, str(tmp_path / "*" / "report.json")).select("channel.channel_id",
        F.col("path").endswith("one/report.json")).first() == ("c", True)
    assert activity.parse_windows("3; 4,1,x,3") == (3, 4)


@pytest.mark.parametrize("text, wanted", [
    ('{"a": "x, [", "b": [1, {"c": "d', '{"a": "x, [", "b": [1, {"c": "d"}]}'), ('{"a": "\\\\", "b":', '{"a": "\\\\"}'), ('{"a": "q\\"', '{"a": "q\\""}'),
    ('{"a": 1, "b": "x\\', '{"a": 1}'), ("[1, 2", None), ('{"a"', None), ("{", "{}"), ('text {"a": {"b": 1}, "c": tru', '{"a": {"b": 1}}'),
])
def test_cut_objects(text, wanted):
    assert model_output.repaired(text) == wanted


def test_imports_that_keep_what_is_there(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "k int, at int, x string")
    new = spark.createDataFrame([(1, 9, "c"), (2, 1, "d"), (3, 2, "f"), (3, 1, "e"), (3, None, "g")], "k int, at int, x string")
    got = lambda **how: sorted((r.k, r.x) for r in cohort.upsert(old, new, "k", "at", **how).collect())
    assert got() == [(1, "c"), (2, "d"), (3, "f")]
    assert got(prefer_old=True) == [(1, "a"), (2, "b"), (3, "e")]


def test_tiers_made_again(spark):
    stored = spark.createDataFrame([("r", 1, 4, 1, 0), ("r", 2, 9, 3, 5), ("r", 3, 2, 2, 1), ("s", 1, 2, 2, None)],
        "run string, actor_id long, n_comments long, n_videos long, likes long")
    sizes = spark.createDataFrame([("r", 60), ("t", 3)], "run string, n_total long")
    got = {(r.run, r.tier): (r.n_commenters, r.pct_commenters) for r in activity.retiered(stored, sizes).collect()}
    assert got == {("r", "one_time"): (1, 33.333333), ("r", "core"): (1, 33.333333), ("r", "regular"): (1, 33.333333), ("s", "returning"): (1, 100.0)}


def test_first_known(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, 3, "c"), (2, 1, None)], "k int, at int, x string")
    assert sorted((r.k, r.x) for r in activity.first_known(rows, "k", ["at"], "x").collect()) == [(1, "b"), (2, None)]


def test_major_affinities(spark):
    rows = spark.createDataFrame([("a", "other", 9.0, 100), ("a", "x", 1.3, 100), ("b", "y", 5.0, 24), ("c", "z", 1.5, 25), ("c", "w", 1.1, 25)],
        "g string, t string, lift double, size long")
    assert [tuple(r) for r in dashboard.top_major_affinity(rows, "g", "t", size="size").collect()] == [("c:z", 1.5)]
    assert dashboard.top_major_affinity(rows.where("lift < 1.2"), "g", "t", size="size").count() == 0


def test_risk_videos_without_enough_comments(spark):
    blocks = spark.createDataFrame([(1, 5, 0.5, 0.0), (2, 6, 0.4, 0.9)], "video_id long, n long, negative_rate double, weighted_negative_rate double")
    share = spark.createDataFrame([(2, 0.1)], "video_id long, actionable double")
    assert [(r.video_id, r.score) for r in dashboard.risk_videos(blocks, share).collect()] == [(1, 0.5), (2, 0.09)]
    assert [r.video_id for r in dashboard.risk_videos(blocks, least=6).collect()] == [2]
    assert dashboard.risk_videos(blocks.limit(0)).count() == 0

"""Relations of outputs of models and of posts with their texts: parsed, repaired, enriched, merged, tiered again.

The raw outputs are JSON objects made of the documents' columns and whole texts, which arrive in seven ways: as they are,
behind a thinking block and in a fence, without the last bracket, cut off in their last text, with words behind them,
not at all, and cut off behind their last key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import model_output
from tidemark.functions.columns import first_line, places
from tidemark.operators import activity, aspects, cohort, events, themes
from tidemark.plans.registry import query
from tidemark.sources import loaders


def arrived(json: Column, last: str, key: Column) -> Column:
    """A JSON object as a model may give it, by the key; `last` is its last field, a text."""
    way = F.pmod(key, F.lit(7))
    cut = lambda n: F.substr(json, F.lit(1), F.length(json) - n)
    head = F.substr(json, F.lit(1), F.length(json) - F.length(F.substring_index(json, f'"{last}":', -1)))
    return F.when(way == 1, F.concat(F.lit('<think>{"label": 1}</think> Here it is:\n```json\n'), json, F.lit("\n```"))).when(way == 2,
        cut(1)).when(way == 3, cut(4)).when(way == 4, F.concat(json, F.lit(" and } no more"))).when(way == 5,
        "no answer").when(way == 6, head).otherwise(json)


def _of(key: Column, *values) -> Column:
    """One of the values, by the key."""
    return F.element_at(F.array(*(F.lit(x) for x in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _told(v) -> DataFrame:
    """Documents with their labels (0 without) and a source that is never null."""
    docs = v.table("documents").select("doc_id", "text", F.coalesce("source", F.lit("nowhere")).alias("source"))
    marks = v.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.join(marks, "doc_id", "left").fillna(0, ["quality", "toxic"])


@query
def parsed_sentiment(v):
    k, scored = F.col("doc_id"), F.col("doc_id") % 5 != 0
    fields = F.struct(_of(k, " Negative ", "positive", "angry", "neutral").alias("label"), F.when(scored, F.col("toxic") * 2.0 + 1).alias("score_neg"),
        F.when(scored, F.lit(1.0)).alias("score_neu"), F.when(scored, F.col("quality") + k % 3 - 1.0).alias("score_pos"), F.col("text").alias("quoted"),
        F.array(F.lit("Joy "), F.lit("joy"), "source").alias("emotion_tags"), (k % 3 * 0.75).alias("toxicity"), (k % 4 * 0.5 - 0.5).alias("confidence"),
        F.concat(F.lit("about "), "source").alias("target"))
    raw = _told(v).select("doc_id", arrived(F.to_json(fields), "target", k).alias("raw"))
    out = model_output.sentiment_labels(raw)
    scores = {f"score_{x}": places(F.col(f"score_{x}")) for x in ("neg", "neu", "pos")}
    return out.withColumns(scores).drop("raw")


@query
def parsed_post_labels(v):
    k = F.col("doc_id")
    fields = F.struct((F.col("quality") == 1).alias("is_relevant"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("is_noise"),
        (k % 2).alias("is_external_event_candidate"), _of(k, "direct_channel_discussion", "nope", "unrelated").alias("relevance_type"),
        _of(k, "other", "apology_or_controversy", "nope", "none").alias("event_type"), _of(k, "critical", " mixed ", "loud").alias("stance"),
        _of(k, "channel", "nobody").alias("target"), F.when(k % 5 == 0, "").otherwise(F.concat("source", F.lit("  topic"))).alias("topic_label"),
        F.when(k % 6 != 0, k % 10 / 5).alias("confidence"), F.col("text").alias("quoted"), F.concat(F.lit("said  of "), "source").alias("reason"))
    return model_output.post_labels(_told(v).select("doc_id", arrived(F.to_json(fields), "reason", k).alias("raw"))).drop("raw")


@query
def parsed_video_labels(v):
    k = F.col("doc_id")
    names = (*themes.THEMES[:6], "nope")
    fields = F.struct(_of(k, *names).alias("primary_theme"), F.array(_of(k + 1, *names), F.lit("nope"), _of(k, *names), _of(k + 1, *names),
        _of(k + 3, *names)).alias("secondary_themes"), _of(k, "travel_vlog", "opera").alias("format"), _of(k, "japan", " usa ", "moon").alias("setting"),
        _of(k, "entertainment", "nothing").alias("audience_intent"), F.array(F.col("source"), F.lit("A  b"), F.lit(" ")).alias("entities"),
        F.when(k % 6 != 0, k % 10 / 5).alias("confidence"), F.col("text").alias("quoted"), F.concat(F.lit("seen  in "), "source").alias("reason"))
    return model_output.video_labels(_told(v).select("doc_id", arrived(F.to_json(fields), "reason", k).alias("raw"))).drop("raw")


@query
def parsed_aspects(v):
    k, names = F.col("doc_id"), (*aspects.ASPECTS[:5], "nope")
    item = lambda i: F.struct(_of(k + i, *names).alias("aspect"), _of(k + i, "negative", "positive", "loud").alias("sentiment"),
        (k % 3 + i).alias("severity"), F.lit(0.25 * (i + 1)).alias("confidence"))
    items = F.slice(F.array(*(item(i) for i in range(6))), 1, (k % 6).cast("int") + 1)
    fields = F.struct(items.alias("aspects"), _of(k + 1, *names).alias("primary_aspect"), F.col("text").alias("quoted"),
        F.concat(F.lit("all  of "), "source").alias("summary"))
    broken = F.concat(F.lit("first {"), F.substring_index(F.to_json(fields), '"quoted"', 1), F.lit(" {{ and no end"))
    raw = F.when(k % 14 == 5, broken).otherwise(arrived(F.to_json(fields), "summary", k))
    return model_output.aspect_labels(_told(v).select("doc_id", raw.alias("raw"))).drop("raw")


#: What is added to the documents' texts, so that each rule of topics finds something.
PHRASES = ("", "請填問卷 抽1000", "他們 道歉 了", "固定班底 離開", "又是 政治", "Cringe 沒梗", "腳本 造假", "求推薦 好看", "nothing else")


def written_posts(v) -> DataFrame:
    """The events as posts whose texts are documents."""
    docs = v.table("documents").select(F.col("doc_id").alias("event_id"), F.concat_ws(" ", "text", _of(F.col("doc_id"), *PHRASES)).alias("text"))
    posts = v.table("events").join(docs, "event_id")
    return posts.select(F.col("event_id").cast("string").alias("post_uid"), "ts", F.to_date("ts").alias("day"), F.coalesce(first_line("text"), F.lit("")).alias("title"),
        F.when(F.col("user_id") % 2 == 0, "forum_a").otherwise("forum_b").alias("source"), F.col("value").alias("engagement"), "text")


def post_judgements(v) -> DataFrame:
    """Labels of a third of the posts as texts, half of them given twice."""
    k = F.col("doc_id")
    word = lambda c, yes, no: F.when(F.col(c) == 1, yes).otherwise(no)
    marks = v.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).where(k % 3 == 0)
    first = marks.select(k.cast("string").alias("post_uid"), F.lit(1).alias("seq"), word("quality", " Yes", "no").alias("is_relevant"), word("toxic", "TRUE",
        "0").alias("is_noise"), F.lit("1").alias("is_external_event_candidate"), F.lit("  ").alias("topic_label"), F.lit("other").alias("event_type"))
    again = marks.where(k % 2 == 0).select(k.cast("string").alias("post_uid"), F.lit(2).alias("seq"), F.lit("y").alias("is_relevant"), word("toxic", "t",
        "f").alias("is_noise"), F.lit(None).cast("string").alias("is_external_event_candidate"), F.lit("politics_or_culture").alias("topic_label"), F.lit("none").alias("event_type"))
    return events.semantic_labels(first.unionByName(again), order="seq")


def _enriched(v) -> DataFrame:
    names = loaders.channel_aliases("@Elle", "  the", None, "elle", "推薦")
    return events.enriched(loaders.aliased(written_posts(v), names), post_judgements(v), require_alias=True)


@query
def enriched_posts(v):
    return _enriched(v).select("post_uid", "day", "title", "alias_hit", "heuristic_topic", "heuristic_noise", "heuristic_relevant", "semantic", "relevant", "noise", "topic", "hint")


@query
def enriched_event_clusters(v):
    """Clusters of days of posts whose topics are read from their texts."""
    return events.event_clusters(_enriched(v))


def _imported(v, prefer_old: bool) -> DataFrame:
    """Labels that are there, and the same table moved by fifty ids as the import, each id twice."""
    old = v.table("labels").select("doc_id", F.col("quality").alias("label"), (F.col("doc_id") % 7).alias("seq"))
    new = v.table("labels").select((F.col("doc_id") + 50).alias("doc_id"), (F.col("toxic") + 10).alias("label"), F.explode(F.array((F.col("doc_id") % 5),
        F.lit(20).cast("bigint"))).alias("seq"))
    return cohort.upsert(old, new, "doc_id", "seq", prefer_old=prefer_old)


@query
def imported_labels(v):
    return _imported(v, False)


@query
def imported_labels_keep_first(v):
    return _imported(v, True)


@query
def retiered_runs(v):
    """Tiers of the channels' commenters, each by the videos of its channel."""
    seen = v.all_comments.join(v.channels, "supplier_id").withColumnRenamed("channel", "run")
    stored = seen.groupBy("run", "actor_id").agg(F.count("*").alias("n_comments"), F.countDistinct("video_id").alias("n_videos"), F.sum("like_count").alias("likes"))
    return activity.retiered(stored, seen.groupBy("run").agg(F.countDistinct("video_id").alias("n_total")))


@query
def first_known_scores(v):
    """Of each actor the first confidence that is known and the video of the first comment."""
    return activity.first_known(v.all_comments, "actor_id", ["ts", "thread_id", "line", "video_id"], "confidence", "video_id")

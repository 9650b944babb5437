"""The sentiment block: one set of measures over any keys, and the relations made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hits, places, ratio

# Words that make a text negative (the base report's list, and the event report's
# two lists, which differ from it).
NEGATIVE_WORDS = ["失望", "難看", "爛", "討厭", "噁", "尷尬", "退訂", "不好笑", "批評", "disappointed", "boring", "bad", "terrible", "hate", "cringe", "unsubscribe"]
EVENT_NEGATIVE_WORDS = ["失望", "難看", "爛", "討厭", "尷尬", "尬", "退訂", "不好笑", "炎上", "出征", "cringe", "bad"]
EVENT_POSITIVE_WORDS = ["好看", "喜歡", "支持", "精彩", "感動", "讚", "推薦", "love", "great"]


SCORES = ("score_neg", "score_neu", "score_pos", "confidence")


def block(weight: Column | None = None) -> list[Column]:
    """Aggregates of a group of labelled comments: counts, weights and rates of the labels, mean scores, and
    replies; a comment weighs its likes and one. Null scores do not count."""
    w = F.col("like_count") + 1 if weight is None else weight
    is_ = lambda label: F.col("label") == label
    of = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    return [
        F.count("*").alias("n"), *(F.count_if(is_(x)).alias(f"n_{x}") for x in ("negative", "neutral", "positive")),
        F.count_if(~F.col("is_top_level")).alias("n_replies"), F.sum(w).alias("weight"),
        *(of(is_(x)).alias(f"{x}_weight") for x in ("negative", "positive")),
        *(places(ratio(F.count_if(is_(x)), F.count("*"))).alias(f"{x}_rate") for x in ("negative", "neutral", "positive")),
        *(places(ratio(of(is_(x)), F.sum(w))).alias(f"weighted_{x}_rate") for x in ("negative", "positive")),
        *(places(F.avg(c)).alias(f"mean_{c}") for c in SCORES),
        places(ratio(F.count_if(~F.col("is_top_level")), F.count("*"))).alias("reply_share"),
        places(ratio(F.count_if(is_("positive")) - F.count_if(is_("negative")), F.count("*"))).alias("net_rate"),
        places(F.avg("like_count")).alias("mean_likes"),
    ]


def prefixed(rows: DataFrame, prefix: str, *keys: str) -> DataFrame:
    """rows whose columns but the keys begin with the prefix."""
    return rows.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c not in keys))


def labelled_or_keyword(comments: DataFrame, labels: DataFrame | None, key: str, text: str = "text") -> DataFrame:
    """Comments with the labels and scores of a model if there are any rows of them (those without one go),
    else by words alone; `sentiment_source` says which."""
    if labels is not None and labels.head(1):
        return comments.join(labels, key).withColumn("sentiment_source", F.lit("model"))
    return keyword_sentiment(comments, text).withColumn("sentiment_source", F.lit("keyword_proxy"))


def sentiment_by(comments: DataFrame, *keys: str, distinct: tuple[str, ...] = ()) -> DataFrame:
    """The block over keys (a null key is a group), with distinct counts where asked for."""
    return comments.groupBy(*keys).agg(*block(), *(F.countDistinct(c).alias(f"n_{c.removesuffix('_id')}s") for c in distinct))


def sentiment_summary(comments: DataFrame) -> DataFrame:
    """Per label: comments, weight, their shares, mean scores and replies."""
    everything = Window.partitionBy()  # one row a label
    out = comments.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("like_count") + 1).alias("weight"),
        F.count_if(~F.col("is_top_level")).alias("n_replies"), *(places(F.avg(c)).alias(f"mean_{c}") for c in SCORES))
    share = lambda c: places(ratio(F.col(c), F.sum(c).over(everything)))
    return out.select("label", "n", share("n").alias("share"), share("weight").alias("weight_share"), "n_replies",
        places(ratio(F.col("n_replies"), F.col("n"))).alias("reply_share"), *(f"mean_{c}" for c in SCORES))


def keyword_sentiment(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labels by words alone, with the scores that such a label stands for."""
    hit = hits(F.col(text), NEGATIVE_WORDS) > 0
    pick = lambda a, b: F.when(hit, a).otherwise(b)
    return docs.withColumns({"label": pick("negative", "neutral"), "score_neg": pick(0.8, 0.1), "score_neu": pick(0.1, 0.8),
        "score_pos": F.lit(0.1), "toxicity": pick(0.3, 0.0), "confidence": pick(0.55, 0.35)})


def event_keyword_sentiment(docs: DataFrame, text: str = "text") -> DataFrame:
    """Three-way labels of the event report: a negative word goes before a positive one."""
    negative, positive = hits(F.col(text), EVENT_NEGATIVE_WORDS) > 0, hits(F.col(text), EVENT_POSITIVE_WORDS) > 0
    return docs.withColumn("label", F.when(negative, "negative").when(positive, "positive").otherwise("neutral"))


def keyword_summary(docs: DataFrame) -> DataFrame:
    """Documents by language and label with mean scores."""
    return keyword_sentiment(docs).groupBy("lang", "label").agg(F.count("*").alias("n"), places(F.avg("score_neg")).alias("score_neg"),
        places(F.avg("confidence")).alias("confidence"))


def hotspots(comments: DataFrame, videos: DataFrame, *, least: int = 1) -> DataFrame:
    """Videos by weighted negative rate, with their theme."""
    own = sentiment_by(comments, "video_id").where(F.col("n") >= least)
    return own.join(videos.select("video_id", "title", "theme"), "video_id").select("video_id", "title", "theme", "n", "negative_rate",
        "weighted_negative_rate")


def source_row(comments: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: comments in scope, those with a label, and the coverage."""
    out = comments.join(labels.select(key).distinct().withColumn("_has", F.lit(1)), key, "left").agg(F.count("*").alias("n_scope"),
        F.count("_has").alias("n_labelled"))
    return out.withColumn("coverage", places(ratio(F.col("n_labelled"), F.col("n_scope"))))


def video_extremes(comments: DataFrame, *, least: int = 10, k: int = 5) -> DataFrame:
    """The k videos of highest positive and of highest negative rate, of those with enough comments."""
    own = sentiment_by(comments, "video_id").where(F.col("n") >= least).select("video_id", "n", "positive_rate", "negative_rate")
    sides = []
    for side in ("positive", "negative"):
        place = F.row_number().over(Window.orderBy(F.desc(f"{side}_rate"), F.desc("n"), "video_id"))
        best = own.orderBy(F.desc(f"{side}_rate"), F.desc("n"), "video_id").limit(k)
        sides.append(best.select(F.lit(side).alias("side"), place.alias("place"), "video_id", "n", F.col(f"{side}_rate").alias("rate")))
    return sides[0].unionByName(sides[1])

"""Reply threads: how opinions clash within and between parents and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import places, ratio, ratio0


REPLY = "not is_top_level"
_RATES = ("positive", "negative")


def thread_metrics(comments: DataFrame, *by: str, actors: bool = True) -> DataFrame:
    """Per thread (of each `by`): counts and rates over all comments and over replies, plain and weighted by
    likes, the parent's label, flags, and what conflicts weigh. Rates over nothing are 0. Without `actors` nobody is
    counted and a thread's rows are shuffled once."""
    is_, reply = lambda x: F.col("label") == x, F.expr(REPLY)
    w = F.col("like_count") + 1
    heavy = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    first = {"video_id": F.min("video_id"), "first_at": F.min("ts"), "last_at": F.max("ts"),
        "_parent": F.min(F.when(F.col("is_top_level"), F.struct("ts", "line", "label")))}
    counts = {"n": F.count("*"), "n_replies": F.count_if(reply), "likes": F.sum("like_count"), "weight": F.sum(w), "reply_weight": heavy(reply)}
    counts |= {f"n_{x[:3]}": F.count_if(is_(x)) for x in _RATES} | {f"r_{x[:3]}": F.count_if(reply & is_(x)) for x in _RATES}
    counts |= {f"w_{x[:3]}": heavy(is_(x)) for x in _RATES}
    if actors:
        # a row for each thread and actor first, so that distinct actors are plain counts
        one = comments.groupBy(*by, "thread_id", "actor_id").agg(*(c.alias(k) for k, c in (first | counts).items()))
        again = {"video_id": F.min("video_id"), "first_at": F.min("first_at"), "last_at": F.max("last_at"), "_parent": F.min("_parent")}
        out = one.groupBy(*by, "thread_id").agg(*(c.alias(k) for k, c in again.items()), *(F.sum(k).alias(k) for k in counts),
            F.count("actor_id").alias("n_actors"), F.count_if(F.col("actor_id").isNotNull() & (F.col("n_replies") > 0)).alias("n_reply_actors"))
    else:
        out = comments.groupBy(*by, "thread_id").agg(*(c.alias(k) for k, c in (first | counts).items()))
    out = out.withColumn("parent_label", F.col("_parent.label")).drop("_parent")
    pos, neg = ratio0(F.col("n_pos"), F.col("n")), ratio0(F.col("n_neg"), F.col("n"))
    rpos, rneg = ratio0(F.col("r_pos"), F.col("n_replies")), ratio0(F.col("r_neg"), F.col("n_replies"))
    out = out.withColumns({"pos": pos, "neg": neg, "rpos": rpos, "rneg": rneg})
    has = F.col("n_replies") > 0
    p, n, rp, rn, parent_is = F.col("pos"), F.col("neg"), F.col("rpos"), F.col("rneg"), lambda x: F.coalesce(F.col("parent_label") == x, F.lit(False))
    out = out.withColumns({
        "thread_bipolarity": 4 * p * n, "reply_bipolarity": 4 * rp * rn,
        "weighted_bipolarity": 4 * ratio0(F.col("w_pos"), F.col("weight")) * ratio0(F.col("w_neg"), F.col("weight")),
        "conflict_thread": has & (((p >= 0.15) & (n >= 0.15)) | ((rp >= 0.15) & (rn >= 0.15))),
        "strict_reply_conflict": (F.col("n_replies") >= 2) & (F.col("r_pos") >= 1) & (F.col("r_neg") >= 1),
        "pile_on": (F.col("n_replies") >= 3) & (rn >= 0.60) & (rp < 0.15),
        "parent_opposition": (parent_is("positive") & (rn >= 0.25)) | (parent_is("negative") & (rp >= 0.25)) | (parent_is("neutral") & (rp >= 0.15) & (rn >= 0.15)),
        "negative_consensus": has & (n >= 0.50) & (p < 0.10),
        "positive_consensus": has & (p >= 0.50) & (n < 0.10),
    })
    out = out.withColumn("conflict_intensity", F.when(F.col("conflict_thread"), F.greatest("thread_bipolarity", "reply_bipolarity")).otherwise(0.0))
    clash = lambda c: F.when(F.col("conflict_thread"), F.col(c)).otherwise(0)
    return out.withColumns({"conflict_replies": clash("n_replies"), "conflict_reply_weight": clash("reply_weight"),
        "reply_intensity": F.col("conflict_intensity") * F.col("n_replies"), "weighted_intensity": F.col("conflict_intensity") * F.col("reply_weight")})


def thread_report(threads: DataFrame) -> DataFrame:
    """The thread relation as it is shown: rates rounded, flags as they are."""
    flags = ["conflict_thread", "strict_reply_conflict", "pile_on", "parent_opposition", "negative_consensus", "positive_consensus"]
    measures = ["thread_bipolarity", "reply_bipolarity", "weighted_bipolarity", "conflict_intensity", "reply_intensity", "weighted_intensity"]
    counts = ["n", "n_replies", "n_actors", "n_reply_actors", "likes", "first_at", "last_at", "parent_label", "conflict_replies", "conflict_reply_weight"]
    return threads.select("thread_id", "video_id", *counts, *flags, *(places(F.col(c), 9).alias(c) for c in measures))


def reply_overview(comments: DataFrame, *by: str) -> DataFrame:
    """One row (of each `by`): comments, replies, threads, who replies, and shares of them."""
    by_thread = comments.groupBy(*by, "thread_id").agg(F.count("*").alias("n"), F.count_if(F.expr(REPLY)).alias("r"),
        F.count_if(F.expr(REPLY) & (F.col("label") == "negative")).alias("g"))
    sums = by_thread.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_comments"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_replies"), F.count("*").alias("n_threads"),
        F.count_if(F.col("r") > 0).alias("n_replied_threads"), F.sum("g").alias("_g"))
    by_actor = comments.groupBy(*by, "actor_id").agg(F.count_if(F.expr(REPLY)).alias("r"))
    actors = by_actor.groupBy(*by).agg(F.count("actor_id").alias("n_commenters"), F.count_if(F.col("r") > 0).alias("n_reply_commenters"))
    out = sums.join(actors, list(by)) if by else sums.crossJoin(actors)  # one row each
    share = {"reply_share": ratio(F.col("n_replies"), F.col("n_comments")),
        "replied_thread_share": ratio(F.col("n_replied_threads"), F.col("n_threads")), "reply_negative_rate": ratio(F.col("_g"), F.col("n_replies"))}
    top = (F.col("n_comments") - F.col("n_replies")).alias("n_top_level")
    return out.select(*by, "n_comments", top, "n_replies", "n_threads", "n_replied_threads", "n_commenters", "n_reply_commenters",
        *(places(c).alias(k) for k, c in share.items()))


def reply_shares(threads: DataFrame, *by: str) -> DataFrame:
    """The shares of reply_overview (of each `by`) from thread_metrics."""
    n, r = F.sum("n"), F.sum("n_replies")
    share = {"reply_share": ratio(r, n), "replied_thread_share": ratio(F.count_if(F.col("n_replies") > 0), F.count("*")),
        "reply_negative_rate": ratio(F.sum("r_neg"), r)}
    return threads.groupBy(*by).agg(*(places(c).alias(k) for k, c in share.items()))


def conflict_scores() -> dict[str, Column]:
    """The scores of a group of threads."""
    clash = F.count_if("conflict_thread")
    rate = ratio0(clash, F.count_if(F.col("n_replies") > 0))
    share, weighted = (ratio0(F.sum(a), F.sum(b)) for a, b in (("conflict_replies", "n_replies"), ("conflict_reply_weight", "reply_weight")))
    return {"conflict_rate_replied": places(rate), "conflict_score": places(clash * rate), "reply_conflict_score": places(clash * share),
        "weighted_conflict_score": places(clash * weighted)}


def conflict_by(threads: DataFrame, *keys: str) -> DataFrame:
    """Conflict of the threads of each key: counts, rates over replied threads, bipolarities, shares of replies
    and of their weight in conflicts, intensities, and scores."""
    has, clash = F.col("n_replies") > 0, F.col("conflict_thread")
    total = lambda c: F.sum(c)
    rate = ratio0(F.count_if(clash), F.count_if(has))
    share, weighted = ratio0(total("conflict_replies"), total("n_replies")), ratio0(total("conflict_reply_weight"), total("reply_weight"))
    part: dict[str, Column] = {
        "n_threads": F.count("*"), "n_replied": F.count_if(has), "n_replies": total("n_replies"), "n_conflict": F.count_if(clash),
        "n_strict": F.count_if("strict_reply_conflict"), "n_pile_on": F.count_if("pile_on"), "n_opposition": F.count_if("parent_opposition"),
        "max_bipolarity": places(F.max("thread_bipolarity")), "mean_bipolarity": places(F.avg("thread_bipolarity")),
        "max_reply_bipolarity": places(F.max("reply_bipolarity")), "mean_reply_bipolarity": places(F.coalesce(F.avg(F.when(has,
        F.col("reply_bipolarity"))), F.lit(0.0))),
        "conflict_rate": places(ratio0(F.count_if(clash), F.count("*"))), "conflict_rate_replied": places(rate),
        "intensity": places(total("conflict_intensity")),
        "conflict_replies": total("conflict_replies"), "conflict_reply_share": places(share),
        "conflict_reply_weight": total("conflict_reply_weight"), "weighted_conflict_share": places(weighted),
        "reply_intensity": places(ratio0(total("reply_intensity"), total("n_replies"))),
        "weighted_intensity": places(ratio0(total("weighted_intensity"), total("reply_weight"))),
        **{k: c for k, c in conflict_scores().items() if k != "conflict_rate_replied"},
        "opposition_score": places(F.count_if("parent_opposition") * rate),
    }
    return threads.groupBy(*keys).agg(*(c.alias(k) for k, c in part.items()))


def video_conflict(threads: DataFrame, comments: DataFrame, videos: DataFrame) -> DataFrame:
    """conflict_by videos, with the sentiment of their replies (0 without any) and what the videos are."""
    w = F.col("like_count") + 1
    is_ = lambda x: F.col("label") == x
    rates = [F.count("*").alias("n_scored_replies")]
    for x in ("negative", "positive"):
        rates += [places(ratio0(F.count_if(is_(x)), F.count("*"))).alias(f"reply_{x}_rate"),
            places(ratio0(F.sum(F.when(is_(x), w).otherwise(0)), F.sum(w))).alias(f"reply_weighted_{x}_rate")]
    replies = comments.where(REPLY).groupBy("video_id").agg(*rates)
    names = [c for c in replies.columns if c != "video_id"]
    out = conflict_by(threads, "video_id").join(replies, "video_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return out.join(videos.select("video_id", "theme", "title", "published_at", "view_count"), "video_id", "left")

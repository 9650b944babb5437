"""Outside events: enriched posts, daily posts, clusters of days, and what changes around them.

Posts: (post_uid, ts, day, title, source, engagement) and, once enriched, topic, hint, semantic,
relevant, noise. Events: (event_id, event_start). All windows are half open and lie around the start of
the event's first day: baseline, pre, post, and follow, which is as long as post. Events and the days
that they reach are few beside the facts; how they are joined is left to the optimizer, which knows
their sizes. Undefined ratios are null.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import contained, hits, lowered, normalized, places, ratio, truthy, two_proportion_z, two_sided_p

# Topics that are weak signals, and the order of topics of equal weight.
LOW_SIGNAL_TOPICS = ("general", "recommendation_or_general_mentions", "survey_or_spam")
TOPIC_PRIORITY = {
    "political_or_social_controversy": 90, "content_authenticity_question": 85, "authenticity_or_fabrication": 85,
    "controversy_or_apology": 80, "controversy_or_criticism": 80,
    "staff_or_host_change": 70, "content_quality_criticism": 65, "politics_or_culture": 60, "recommendation_or_general_mentions": 20, "general": 10,
}
OTHER_PRIORITY = 40
# Topics in order and the words that point to each; words of noise.
TOPIC_RULES = [
    ("survey_or_spam", ["問卷", "填問卷", "抽1000", "學術問卷", "survey"]),
    ("controversy_or_apology", ["道歉", "炎上", "出征", "爭議", "被罵", "得罪", "apology"]),
    ("staff_or_host_change", ["主持", "員工", "工作人員", "固定班底", "成員", "拆夥", "離開"]),
    ("political_or_social_controversy", ["統戰", "政治", "中共同路人", "西藏", "台派"]),
    ("content_quality_criticism", ["尬", "沒梗", "失望", "難看", "水準", "不好笑", "生氣", "媽寶", "cringe"]),
    ("content_authenticity_question", ["set", "造假", "真的假的", "真實", "剪輯", "腳本", "草皮"]),
    ("recommendation_or_general_mentions", ["推薦", "求推薦", "好看", "精彩"]),
]
NOISE_WORDS = ["問卷", "填問卷", "抽1000", "學術問卷", "表單"]
TRUTHY = ("1", "true", "yes", "y", "t")
WINDOWS = ("baseline", "pre", "post")


class Settings(NamedTuple):
    """Thresholds of days and clusters, and the lengths of the windows in days."""

    min_daily_posts: int = 2
    min_event_posts: int = 1
    min_engagement: float = 10
    merge_gap_days: int = 3
    merge_cross_topic: bool = False
    baseline: int = 90
    pre: int = 28
    post: int = 28

    @property
    def days(self) -> dict[str, int]:
        return {"baseline": self.baseline, "pre": self.pre, "post": self.post}


def _topic(t: Column) -> Column:
    out = F.when(contained(t, TOPIC_RULES[0][1]) > 0, TOPIC_RULES[0][0])
    for topic, words in TOPIC_RULES[1:]:
        out = out.when(contained(t, words) > 0, topic)
    return out.otherwise("general")


def heuristic_topic(text: Column) -> Column:
    """The first topic one of whose words the normalised text contains."""
    return lowered(normalized(text), _topic)


def noise(text: Column) -> Column:
    return hits(normalized(text), NOISE_WORDS) > 0


def semantic_labels(labels: DataFrame, *, order: str | None = None) -> DataFrame:
    """One row of each post_uid (the last by `order`), truth values as booleans."""
    for c in ("is_relevant", "is_noise", "is_external_event_candidate", "semantic_parse_error"):
        if c in labels.columns:
            labels = labels.withColumn(c, truthy(F.col(c), TRUTHY))
    by = F.desc_nulls_last(order) if order else F.lit(1)
    place = F.row_number().over(Window.partitionBy("post_uid").orderBy(by))
    return labels.withColumn("_place", place).where("_place = 1").drop("_place", *([order] if order else []))


def enriched(posts: DataFrame, labels: DataFrame | None = None, *, require_alias: bool = False) -> DataFrame:
    """posts (with text and alias_hit) with heuristic and, where there are any, semantic judgements:
    relevant, noise, topic, hint and semantic (whether the post has a label)."""
    both = lambda t: F.struct(_topic(t).alias("topic"), (contained(t, NOISE_WORDS) > 0).alias("noise"))
    out = posts.withColumn("_read", lowered(normalized(F.col("text")), both))  # the text is normalised once
    out = out.withColumns({"heuristic_topic": F.col("_read.topic"), "heuristic_noise": F.col("_read.noise")}).drop("_read")
    out = out.withColumn("heuristic_relevant", ~F.col("heuristic_noise") & (F.col("alias_hit") if require_alias else F.lit(True)))
    kinds = {"is_relevant": "boolean", "is_noise": "boolean", "is_external_event_candidate": "boolean", "topic_label": "string", "event_type": "string"}
    if labels is not None:
        known = [c for c in kinds if c in labels.columns]
        out = out.join(labels.select("post_uid", *known), "post_uid", "left")
        kinds = {c: k for c, k in kinds.items() if c not in known}
    out = out.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    named = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return out.withColumns({
        "semantic": F.col("is_relevant").isNotNull(), "relevant": F.coalesce("is_relevant", "heuristic_relevant"),
        "noise": F.coalesce("is_noise", "heuristic_noise"),
        "topic": F.coalesce(named("topic_label"), named("event_type"), F.col("heuristic_topic")),
        "hint": F.coalesce("is_external_event_candidate", F.lit(False)),
    })


def _eligible(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("relevant") & ~F.col("noise"))


def _listed(rows: DataFrame, by: list[str], column: str, k: int, separator: str) -> DataFrame:
    """(by, column): the first k values in order of time, source, title and id, joined. Rows beyond the
    k first of a group are left out before they are shuffled."""
    order = Window.partitionBy(*by).orderBy("ts", "source", "title", "post_uid")
    top = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    items = F.array_sort(F.collect_list(F.struct("_place", column)))
    return top.groupBy(*by).agg(F.array_join(items[column], separator).alias("_list"))


def _post_sums() -> list[Column]:
    names = lambda c, sep: F.array_join(F.array_sort(F.collect_set(c)), sep)
    return [
        F.count("*").alias("n_posts"), places(F.sum("engagement"), 2).alias("engagement"), names("source", ",").alias("sources"),
        names("topic", ";").alias("topics"),
        F.count_if("semantic").alias("n_semantic"), F.count_if("hint").alias("n_hints"),
    ]


def daily_posts(posts: DataFrame) -> DataFrame:
    """Per day of relevant posts without noise: posts, engagement, sources and topics in order, first
    titles, labelled posts, hints, and the commonest topic (ties: the first by name)."""
    rows = _eligible(posts)
    by_topic = rows.groupBy("day", "topic").agg(F.count("*").alias("n"))
    mode = by_topic.groupBy("day").agg(F.min_by("topic", F.struct(-F.col("n"), F.col("topic"))).alias("top_topic"))
    titles = _listed(rows, ["day"], "title", 4, " || ").withColumnRenamed("_list", "top_titles")
    return rows.groupBy("day").agg(*_post_sums()).join(mode, "day").join(titles, "day")


def _strong(topic: str, least: int, settings: Settings) -> Column:
    """Whether a day or cluster is a candidate: a hint, several sources, engagement, or posts enough."""
    weak = max(settings.min_daily_posts * 2, settings.min_event_posts, 4)
    enough = F.when(F.col(topic).isin(*LOW_SIGNAL_TOPICS), F.col("n_posts") >= weak).otherwise(F.col("n_posts") >= least)
    return (F.col("n_hints") > 0) | F.col("sources").contains(",") | (F.col("engagement") >= settings.min_engagement) | enough


def candidate_days(daily: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return daily.where(_strong("top_topic", settings.min_daily_posts, settings))


def day_runs(days: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Candidate days with `run`: of each topic (or of all) a gap of more than merge_gap_days begins
    another. One row a day: the window over all days, if topics merge, is small."""
    key = [] if settings.merge_cross_topic else ["top_topic"]
    order = Window.partitionBy(*key).orderBy("day")
    new = F.coalesce((F.date_diff("day", F.lag("day").over(order)) > max(settings.merge_gap_days, 0)).cast("int"), F.lit(1))
    first = F.first("top_topic").over(order) if key else F.lit("")
    return days.withColumn("_new", new).withColumn("run", F.concat_ws("#", first, F.sum("_new").over(order))).drop("_new")


def topic_votes(posts: DataFrame, by: str) -> DataFrame:
    """(by, topic, votes): the topic of each group by weighted votes of its posts: 1 and
    ln(1 + engagement), 25 for a hint, 5 for a label. Spam has no vote; topics that are weak signals lose
    to any other; ties go by priority and then to the last name."""
    vote = 1 + F.log1p(F.greatest(F.lit(0.0), F.col("engagement"))) + 25 * F.col("hint").cast("int") + 5 * F.col("semantic").cast("int")
    topic = F.coalesce(F.nullif(F.trim("topic"), F.lit("")), F.lit("general"))
    votes = posts.select(by, topic.alias("topic"), vote.alias("v")).where("topic <> 'survey_or_spam'")
    votes = votes.groupBy(by, "topic").agg(places(F.sum("v"), 4).alias("votes"))
    known = F.create_map(*(x for k, p in TOPIC_PRIORITY.items() for x in (F.lit(k), F.lit(p))))
    priority = F.coalesce(F.try_element_at(known, F.col("topic")), F.lit(OTHER_PRIORITY))
    order = F.struct((~F.col("topic").isin(*LOW_SIGNAL_TOPICS)).cast("int"), "votes", priority, "topic")
    return votes.groupBy(by).agg(F.max_by("topic", order).alias("topic"), F.max_by("votes", order).alias("votes"))


def event_clusters(posts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Clusters of candidate days with the posts that they hold: those of the cluster's topic, or, if
    these are too few or topics merge, all. The peak is the day of most posts (then engagement, then
    the first)."""
    rows = _eligible(posts)
    runs = day_runs(candidate_days(daily_posts(posts), settings), settings)
    peak = F.struct("n_posts", "engagement", -F.unix_date("day"))
    frame = runs.groupBy("run").agg(F.min("day").alias("event_start"), F.max("day").alias("event_end"),
        F.max_by("day", peak).alias("event_date"), F.max_by("top_topic", peak).alias("_topic"), F.sum("n_posts").alias("_posts"))
    days = frame.select("run", "_topic", "_posts", F.explode(F.sequence("event_start", "event_end")).alias("day"))
    held = rows.join(days, "day")
    if settings.merge_cross_topic:
        chosen = held
        topics = frame.join(topic_votes(held, "run"), "run", "left").select("run", F.coalesce("topic", "_topic").alias("event_topic"))
    else:
        own = held.where(F.col("topic") == F.col("_topic")).groupBy("run").agg(*_post_sums())
        least = max(settings.min_event_posts, settings.min_daily_posts)
        passes = (F.col("n_posts") >= least) | F.col("sources").contains(",") | (F.col("engagement") >= settings.min_engagement) | (F.col("n_hints") > 0)
        mixed = ~F.coalesce(passes, F.lit(False)) & (F.col("_posts") >= settings.min_daily_posts)
        topics = frame.join(own, "run", "left").select("run", F.when(mixed, "mixed_external_discussion").otherwise(F.col("_topic")).alias("event_topic"))
        chosen = held.join(topics, "run").where((F.col("event_topic") == "mixed_external_discussion") | (F.col("topic") == F.col("event_topic"))).drop("event_topic")
    titles = _listed(chosen, ["run"], "title", 5, " || ").withColumnRenamed("_list", "top_titles")
    uids = _listed(chosen, ["run"], "post_uid", 20, ";").withColumnRenamed("_list", "post_uids")
    out = frame.drop("_topic", "_posts").join(topics, "run").join(chosen.groupBy("run").agg(*_post_sums()), "run").join(titles, "run").join(uids, "run")
    out = out.where(_strong("event_topic", max(settings.min_event_posts, settings.min_daily_posts), settings))
    # one row a cluster
    number = F.row_number().over(Window.orderBy("event_start", F.desc("n_posts"), F.desc("engagement"), "run"))
    return out.select(F.format_string("external_event_%03d", number).alias("event_id"), "event_start", "event_end", "event_date",
        "event_topic", "sources", "n_posts", "engagement", "n_semantic", "n_hints", "top_titles", "post_uids")


def in_windows(facts: DataFrame, events: DataFrame, settings: Settings = Settings(), *, start: str = "event_start") -> DataFrame:
    """Each fact (ts) with every event in whose windows it lies. Events are exploded to the days that
    they reach, so that the join is one of equal days."""
    base, pre, post = settings.baseline, settings.pre, settings.post
    reach = F.sequence(F.date_sub(start, base + pre), F.date_add(start, 2 * post - 1))
    days = events.select("event_id", F.col(start).alias("_start"), F.explode(reach).alias("_day"))
    offset = F.date_diff("_day", "_start")
    window = F.when(offset < -pre, "baseline").when(offset < 0, "pre").when(offset < post, "post").otherwise("follow")
    return facts.withColumn("_day", F.to_date("ts")).join(days.withColumn("window", window), "_day").drop("_day", "_start")


def _z(prefix: str, a: str, b: str, k: str, n: str) -> list[Column]:
    """z of window b against window a, and its two-sided p."""
    z = two_proportion_z(F.col(f"{b}_{k}"), F.col(f"{b}_{n}"), F.col(f"{a}_{k}"), F.col(f"{a}_{n}"))
    return [places(z).alias(f"{prefix}_z"), places(two_sided_p(z)).alias(f"{prefix}_p")]


def _counts(names: list[str]) -> list[Column]:
    return [F.coalesce(c, F.lit(0)).alias(c) for c in names]


def event_windows(comments: DataFrame, events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per event: counts and negative rates of the three windows, plain and weighted by likes, and
    changes, lifts and tests of the post window against the others."""
    held = in_windows(comments.select("ts", "label", "like_count"), events, settings)
    neg, weight = F.col("label") == "negative", F.greatest(F.coalesce("like_count", F.lit(0)), F.lit(0)) + 1
    sums: list[Column] = []
    for w in WINDOWS:
        at = F.col("window") == w
        sums += [F.count_if(at).alias(f"{w}_n"), F.count_if(at & neg).alias(f"{w}_neg"), F.sum(F.when(at, weight)).alias(f"{w}_w"),
            F.sum(F.when(at & neg, weight)).alias(f"{w}_wneg")]
    out = events.select("event_id").join(held.groupBy("event_id").agg(*sums), "event_id", "left")
    rate = lambda w: ratio(F.col(f"{w}_neg"), F.col(f"{w}_n"))
    heavy = lambda w: ratio(F.coalesce(f"{w}_wneg", F.lit(0)), F.col(f"{w}_w"))
    amp = lambda w: ratio(heavy(w), rate(w))
    lift = ratio(F.col("post_n") / settings.post, F.col("baseline_n") / settings.baseline)
    return out.select(
        "event_id", *_counts([f"{w}_n" for w in WINDOWS]), *(places(rate(w)).alias(f"{w}_negative_rate") for w in WINDOWS),
        *(places(heavy(w)).alias(f"{w}_weighted_negative_rate") for w in WINDOWS),
        places(ratio(F.col("post_n"), F.col("pre_n"))).alias("count_ratio"), places(lift).alias("volume_lift"),
        places(100 * (rate("post") - rate("pre"))).alias("delta_pre_pp"), places(100 * (rate("post") - rate("baseline"))).alias("delta_pp"),
        places(100 * (heavy("post") - heavy("pre"))).alias("weighted_delta_pre_pp"),
        places(100 * (heavy("post") - heavy("baseline"))).alias("weighted_delta_pp"),
        *_z("pre", "pre", "post", "neg", "n"), *_z("baseline", "baseline", "post", "neg", "n"),
        places(amp("baseline")).alias("baseline_amplification"), places(amp("post")).alias("amplification"),
        places(ratio(amp("post"), amp("baseline"))).alias("amplification_lift"),
    )


def half_life(comments: DataFrame, events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per event: days until the negative rate over three rows of days is down to the baseline and half
    of the lift of the first three days (or of the first day with comments); `post` where that is
    never seen; null without a lift."""
    held = in_windows(comments.select("ts", "label"), events, settings)
    neg = F.count_if(F.col("label") == "negative")
    base = held.where("window = 'baseline'").groupBy("event_id").agg(ratio(neg, F.count("*")).alias("base"))
    daily = held.where("window = 'post'").groupBy("event_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), neg.alias("neg"))
    order = Window.partitionBy("event_id").orderBy("day")
    three = order.rowsBetween(-2, 0)
    daily = daily.withColumn("rolling", ratio(F.sum("neg").over(three), F.sum("n").over(three))).join(events.select("event_id", "event_start"), "event_id")
    at = F.date_diff("day", "event_start")
    early = at < 3
    first = daily.groupBy("event_id").agg(F.sum(F.when(early, F.col("neg"))).alias("a"), F.sum(F.when(early, F.col("n"))).alias("b"),
        F.min_by(ratio(F.col("neg"), F.col("n")), "day").alias("c"))
    first = first.select("event_id", F.coalesce(ratio(F.col("a"), F.col("b")), F.col("c")).alias("early"))
    rows = daily.join(base, "event_id").join(first, "event_id").where(F.col("early") > F.col("base"))
    low = F.when(F.col("rolling") <= F.col("base") + (F.col("early") - F.col("base")) / 2, at)
    found = rows.groupBy("event_id").agg(F.coalesce(F.min(low), F.lit(settings.post)).alias("half_life_days"), F.min(low).isNotNull().alias("_seen"))
    return events.select("event_id").join(found, "event_id", "left").select("event_id", "half_life_days", F.coalesce("_seen", F.lit(False)).alias("observed"))


def _near(videos: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, video_id, title, published_at) of videos that came out within a week of the event."""
    days = events.select("event_id", F.explode(F.sequence(F.date_sub("event_start", 7), F.date_add("event_start", 7))).alias("_day"))
    return videos.select("video_id", "title", "published_at", F.to_date("published_at").alias("_day")).join(days, "_day").drop("_day")


def nearby_titles(videos: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, nearby_titles): the first five videos that came out within a week of the event."""
    order = Window.partitionBy("event_id").orderBy("published_at", "video_id")
    top = _near(videos, events).withColumn("_place", F.row_number().over(order)).where("_place <= 5")
    titles = F.array_sort(F.collect_list(F.struct("_place", F.coalesce("title", F.lit("")).alias("title"))))
    listed = top.groupBy("event_id").agg(F.array_join(titles["title"], " || ").alias("nearby_titles"))
    return events.select("event_id").join(listed, "event_id", "left").select("event_id", F.coalesce("nearby_titles", F.lit("")).alias("nearby_titles"))


def spillover(comments: DataFrame, events: DataFrame, videos: DataFrame, settings: Settings = Settings(), *, least: int = 30, rise: float = 0.05) -> DataFrame:
    """Per event: videos with comments after it, and those affected (`least` comments, negative rate
    above the baseline by `rise`), split by whether they came out near the event."""
    held = in_windows(comments.select("ts", "label", "video_id"), events, settings)
    neg = F.count_if(F.col("label") == "negative")
    base = held.where("window = 'baseline'").groupBy("event_id").agg(ratio(neg, F.count("*")).alias("base"))
    own = held.where("window = 'post'").groupBy("event_id", "video_id").agg(F.count("*").alias("n"),
        ratio(neg, F.count("*")).alias("rate")).join(base, "event_id")
    near = _near(videos, events).select("event_id", "video_id", F.lit(True).alias("_near"))
    hit = (F.col("n") >= least) & (F.col("rate") >= F.col("base") + rise)
    flagged = own.join(near, ["event_id", "video_id"], "left")
    out = flagged.groupBy("event_id").agg(F.count("*").alias("n_videos"), F.count_if(hit).alias("n_affected"),
        F.count_if(hit & F.col("_near")).alias("n_near"), F.count_if(hit & F.col("_near").isNull()).alias("n_other"))
    return events.select("event_id").join(out, "event_id", "left").select("event_id",
        *_counts(["n_videos", "n_affected", "n_near", "n_other"]), places(ratio(F.col("n_other"), F.col("n_near"))).alias("spillover_ratio"))


def conflict_windows(threads: DataFrame, events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per event and window: threads, replied and conflict threads, their rate, conflicts by their rate,
    pile-ons and parent oppositions. threads: (ts, n_replies, conflict_thread, pile_on, parent_opposition)."""
    held = in_windows(threads.select("ts", "n_replies", "conflict_thread", "pile_on", "parent_opposition"), events, settings).where("window <> 'follow'")
    sums = held.groupBy("event_id", "window").agg(F.count("*").alias("n_threads"), F.count_if(F.col("n_replies") > 0).alias("n_replied"),
        F.count_if("conflict_thread").alias("n_conflict"), F.count_if("pile_on").alias("n_pile_on"), F.count_if("parent_opposition").alias("n_opposition"))
    every = events.select("event_id", F.explode(F.array(*map(F.lit, WINDOWS))).alias("window"))
    rate = ratio(F.col("n_conflict"), F.col("n_replied"))
    out = every.join(sums, ["event_id", "window"], "left")
    return out.select("event_id", "window", *_counts(["n_threads", "n_replied", "n_conflict", "n_pile_on", "n_opposition"]),
        places(rate).alias("conflict_rate"), places(F.coalesce(F.col("n_conflict") * rate, F.lit(0.0))).alias("conflict_score"))


def conflict_lift(windows: DataFrame) -> DataFrame:
    """Per event: conflict scores of baseline and post windows, their difference and ratio, and the pile-ons
    and oppositions after the event; windows: conflict_windows."""
    at = lambda w, c: F.max(F.when(F.col("window") == w, F.col(c)))
    out = windows.groupBy("event_id").agg(at("baseline", "conflict_score").alias("baseline_conflict"),
        at("post", "conflict_score").alias("post_conflict"), at("post", "n_pile_on").alias("post_pile_on"), at("post", "n_opposition").alias("post_opposition"))
    change = F.col("post_conflict") - F.col("baseline_conflict")
    return out.withColumns({"conflict_delta": places(change), "conflict_lift": places(ratio(F.col("post_conflict"), F.col("baseline_conflict")))})


def _first_seen(comments: DataFrame) -> DataFrame:
    return comments.groupBy("actor_id").agg(F.to_date(F.min("ts")).alias("_first"))


def audience_windows(comments: DataFrame, events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per event: active and new actors of the three windows, changes and tests of the new ones' share,
    their comments after the event, and how many of them come back in the window that follows. An actor
    is new where first seen. comments: top-level ones (ts, actor_id)."""
    comments = comments.where("actor_id is not null and ts is not null").select("actor_id", "ts")
    held = in_windows(comments, events, settings)
    seen = held.groupBy("event_id", "actor_id").agg(*(F.count_if(F.col("window") == w).alias(w) for w in (*WINDOWS, "follow")))
    seen = seen.join(_first_seen(comments), "actor_id").join(events.select("event_id", "event_start"), "event_id").withColumn("_at",
        F.date_diff("_first", "event_start"))
    span = {"baseline": (-(settings.baseline + settings.pre), -settings.pre), "pre": (-settings.pre, 0), "post": (0, settings.post)}
    new = {w: (F.col(w) > 0) & (F.col("_at") >= a) & (F.col("_at") < b) for w, (a, b) in span.items()}
    sums = [F.count_if(F.col(w) > 0).alias(f"{w}_active") for w in WINDOWS] + [F.count_if(new[w]).alias(f"{w}_new") for w in WINDOWS]
    sums += [F.sum("post").alias("_comments"), F.coalesce(F.sum(F.when(new["post"], F.col("post"))), F.lit(0)).alias("new_comments"),
        F.count_if(new["post"] & (F.col("follow") > 0)).alias("returned")]
    out = events.select("event_id", "event_start").join(seen.groupBy("event_id").agg(*sums), "event_id", "left")
    last = comments.agg(F.max("ts").alias("_last"))  # one row
    out = out.crossJoin(last)
    share = lambda w: ratio(F.col(f"{w}_new"), F.col(f"{w}_active"))
    end = F.date_add("event_start", 2 * settings.post).cast("timestamp")
    begin = F.date_add("event_start", settings.post).cast("timestamp")
    seconds = F.unix_timestamp(F.least("_last", end)) - F.unix_timestamp(begin)
    return out.select(
        "event_id", *_counts([f"{w}_{k}" for k in ("active", "new") for w in WINDOWS]), *(places(share(w)).alias(f"{w}_new_share") for w in WINDOWS),
        places(100 * (share("post") - share("pre"))).alias("new_delta_pre_pp"), places(100 * (share("post") - share("baseline"))).alias("new_delta_pp"),
        *_z("new_pre", "pre", "post", "new", "active"), *_z("new", "baseline", "post", "new", "active"),
        *_counts(["new_comments"]), places(ratio(F.col("new_comments"), F.col("_comments"))).alias("new_comment_share"),
        *_counts(["returned"]), places(ratio(F.col("returned"), F.col("post_new"))).alias("newcomer_return_rate"),
        F.greatest(F.lit(0), F.ceil(seconds / 86400)).cast("int").alias("follow_days"), (F.col("_last") >= end).alias("follow_complete"),
    )


def newcomer_sentiment(comments: DataFrame, events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per event: negative rates after it, plain and weighted, of actors first seen then and of the
    others, and the gaps in percentage points. comments: top-level ones."""
    comments = comments.where("actor_id is not null and ts is not null")
    held = in_windows(comments.select("ts", "label", "actor_id", "like_count"), events, settings).where("window = 'post'")
    held = held.join(_first_seen(comments), "actor_id").join(events.select("event_id", "event_start"), "event_id")
    new, neg = F.col("_first") >= F.col("event_start"), F.col("label") == "negative"
    weight = F.greatest(F.coalesce("like_count", F.lit(0)), F.lit(0)) + 1
    sums = []
    for name, mine in (("new", new), ("old", ~new)):
        sums += [F.count_if(mine).alias(f"n_{name}"), F.count_if(mine & neg).alias(f"{name}_neg"),
            F.sum(F.when(mine, weight)).alias(f"{name}_w"), F.coalesce(F.sum(F.when(mine & neg, weight)), F.lit(0)).alias(f"{name}_wneg")]
    out = events.select("event_id").join(held.groupBy("event_id").agg(*sums), "event_id", "left")
    rate = lambda x: ratio(F.col(f"{x}_neg"), F.col(f"n_{x}"))
    heavy = lambda x: ratio(F.col(f"{x}_wneg"), F.col(f"{x}_w"))
    return out.select("event_id", *_counts(["n_new", "n_old"]), *(places(rate(x)).alias(f"{x}_negative_rate") for x in ("new", "old")),
        places(100 * (rate("new") - rate("old"))).alias("gap_pp"), *(places(heavy(x)).alias(f"{x}_weighted_negative_rate") for x in ("new",
        "old")), places(100 * (heavy("new") - heavy("old"))).alias("weighted_gap_pp"))


# Signals in order and what they are called.
SIGNALS = {
    "negative_response": "negative_response_above_baseline", "new_audience": "new_audience_entry_above_baseline",
    "newcomer_negative": "new_commenters_more_negative",
    "conflict": "reply_conflict_lift", "spillover": "negative_spillover_beyond_event_nearby_videos",
}


def impact_diagnostics(windows: DataFrame, audience: DataFrame, newcomers: DataFrame, conflicts: DataFrame, spill: DataFrame) -> DataFrame:
    """The five signals of each event, how many hold, and their names."""
    parts = [
        windows.select("event_id", "delta_pp", "baseline_p"), audience.select("event_id", "new_delta_pp", "new_p"), newcomers.select("event_id", "gap_pp"),
        conflict_lift(conflicts).select("event_id", "conflict_lift"), spill.select("event_id", "spillover_ratio"),
    ]
    out = reduce(lambda a, b: a.join(b, "event_id", "left"), parts)
    flags = {
        "negative_response": (F.col("delta_pp") >= 3) & (F.col("baseline_p") < 0.05), "new_audience": (F.col("new_delta_pp") >= 2) & (F.col("new_p") < 0.05),
        "newcomer_negative": F.col("gap_pp") >= 3, "conflict": F.col("conflict_lift") >= 2, "spillover": F.col("spillover_ratio") > 1,
    }
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    out = out.withColumns(flags)
    names = F.array_join(F.filter(F.array(*(F.when(F.col(k), F.lit(SIGNALS[k])) for k in flags)), lambda x: x.isNotNull()), ";")
    count = sum((F.col(k).cast("int") for k in flags), F.lit(0))
    return out.select("event_id", *flags, count.alias("n_signals"), F.when(names == "", "weak_or_baseline_like").otherwise(names).alias("interpretation"))


def external_summary(posts: DataFrame, daily: DataFrame, clusters: DataFrame, *, status: str = "ok", settings: Settings = Settings()) -> DataFrame:
    """One row: posts, relevant, labelled and noise posts, days, candidate days, clusters, windows."""
    own = posts.agg(F.count("*").alias("n_posts"), F.count_if("relevant").alias("n_relevant"), F.count_if("semantic").alias("n_semantic"),
        F.count_if("noise").alias("n_noise"), F.countDistinct("day").alias("n_days"))
    out = own.crossJoin(daily.agg(F.count("*").alias("n_candidate_days"))).crossJoin(clusters.agg(F.count("*").alias("n_clusters")))  # one row each
    kind = F.when(F.col("n_semantic") > 0, "external_post_labels").otherwise("heuristic_alias_topic")
    return out.select(F.lit(status).alias("status"), "*", kind.alias("semantics_source"), *(F.lit(v).alias(f"{k}_days") for k, v in settings.days.items()))


def audience_summary(audience: DataFrame) -> DataFrame:
    """One row: events whose share of new actors rose or fell significantly, and the mean change."""
    sure, pp = F.col("new_p") < 0.05, F.col("new_delta_pp")
    return audience.where("new_p is not null").agg(F.count("*").alias("n_events"), F.count_if(sure & (pp > 0)).alias("n_up"),
        F.count_if(sure & (pp < 0)).alias("n_down"), places(F.avg(pp), 4).alias("mean_pp"))

"""Themes: rules over text, label lists, summaries, and affinity (lift) of groups for labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import contained, label_list, places, ratio

# Themes in order and the words that point to each.
THEME_RULES = [
    ("food_culture", ["美食", "食物", "餐廳", "料理", "吃", "food", "restaurant", "cooking"]),
    ("business_brand", ["創業", "品牌", "開店", "營運", "加盟", "business", "brand", "store"]),
    ("automotive_luxury", ["超跑", "跑車", "車", "法拉利", "保時捷", "benz", "bmw", "toyota", "car"]),
    ("controversy_response", ["回應", "爭議", "風波", "道歉", "聲明", "爆料", "controversy", "response"]),
    ("travel_exploration", ["旅遊", "旅行", "探索", "travel", "trip", "vlog", "country"]),
    ("city_lifestyle", ["城市", "生活", "city", "life", "living", "taiwan", "台灣", "america", "美國"]),
    ("physical_challenge", ["挑戰", "challenge", "ironman", "marathon", "race", "健身", "運動"]),
    ("survival_outdoor", ["荒島", "求生", "survival", "camping", "deserted", "outdoor"]),
    ("workplace_tech_career", ["工作", "職涯", "科技", "工程師", "apple", "engineer", "career", "tech", "office"]),
    ("education_advice", ["教學", "學", "如何", "建議", "advice", "learn", "education", "how to"]),
    ("personal_team_life", ["生日", "家人", "朋友", "團隊", "日常", "family", "team", "birthday", "personal"]),
    ("guest_relationship", ["來賓", "女友", "老婆", "訪問", "guest", "interview", "relationship"]),
    ("product_review", ["開箱", "評測", "review", "product", "買", "unbox"]),
    ("event_announcement", ["公告", "announcement", "重大", "宣布", "update"]),
]


def classified(df: DataFrame, text: Column) -> DataFrame:
    """df with primary_theme (most words found; ties: the earlier rule) and theme_labels (all
    rules that found one, `;`-joined); `other` where none did."""
    counted = df.withColumn("_lower", F.lower(F.coalesce(text, F.lit(""))))
    # counts are columns of their own, so that the text is lowered once and they are compiled
    counted = counted.withColumns({f"_n{i}": contained(F.col("_lower"), words) for i, (_, words) in enumerate(THEME_RULES)})
    rules = (F.struct(F.col(f"_n{i}").alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, _) in enumerate(THEME_RULES))
    out = counted.withColumn("_found", F.filter(F.array(*rules), lambda x: x["n"] > 0))
    some = F.size("_found") > 0
    labels = F.array_join(F.transform("_found", lambda x: x["name"]), ";")
    out = out.withColumns({
        "primary_theme": F.when(some, F.array_max("_found")["name"]).otherwise("other"),
        "theme_labels": F.when(some, labels).otherwise("other"),
    })
    return out.drop("_found", "_lower", *(f"_n{i}" for i in range(len(THEME_RULES))))


def labels_long(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row for each label of a `;` list."""
    return df.select(*keys, F.explode(label_list(F.col(column))).alias("label"))


def theme_summary(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Comments and commenters of each theme beside its videos; a missing side counts 0."""
    seen = comments.join(videos.select("video_id", "theme"), "video_id").groupBy("theme").agg(F.count("*").alias("n_comments"),
        F.countDistinct("actor_id").alias("n_commenters"))
    own = videos.groupBy("theme").agg(F.count("*").alias("n_videos"))
    return seen.join(own, "theme", "full").select("theme", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_videos", "n_comments", "n_commenters")))


def affinity(pairs: DataFrame, group: str, label: str, units: DataFrame | None = None) -> DataFrame:
    """lift of each (group, label) over distinct pairs: the label's share in the group over its
    share in all. A pair counts once for each of its labels; `_pair` names it. Shares are of the pairs
    that have labels, or of those of `units` (group, _pair) where it is given."""
    total = (pairs if units is None else units).select(group, "_pair").distinct()
    by_group = total.groupBy(group).agg(F.count("*").alias("group_pairs"))
    by_both = pairs.select(group, label, "_pair").distinct().groupBy(group, label).agg(F.count("*").alias("pairs"))
    everything = Window.partitionBy()
    by_group = by_group.withColumn("all_pairs", F.sum("group_pairs").over(everything))
    out = by_both.join(by_group, group).withColumn("label_pairs", F.sum("pairs").over(Window.partitionBy(label)))
    share, overall = ratio(F.col("pairs"), F.col("group_pairs")), ratio(F.col("label_pairs"), F.col("all_pairs"))
    return out.select(group, label, "pairs", "group_pairs", "label_pairs", places(share).alias("share"), places(overall).alias("overall_share"),
        places(ratio(share, overall)).alias("lift"))


def top_text(df: DataFrame, group: str, label: Column, value: str, k: int = 5) -> DataFrame:
    """(group, top): the k labels of greatest value as `label (value); ...`, labels cut to 48."""
    shown = F.concat(F.substring(label.cast("string"), 1, 48), F.lit(" ("), F.col(value).cast("string"), F.lit(")"))
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), label))).where(F.col("_place") <= k)
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", shown.alias("t")))),
        lambda x: x["t"]), "; ").alias("top"))


THEMES = tuple(name for name, _ in THEME_RULES)


def clean_theme(c: Column) -> Column:
    """The theme if it is one of the known, else `other`."""
    own = F.trim(c)
    return F.when(own.isin(*THEMES), own).otherwise("other")


def clean_theme_labels(c: Column) -> Column:
    """A list at `;`, `,` or `|` as known themes, first of equals, `;`-joined; `other` for none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,|]"), lambda x: F.trim(x))
    known = F.array_distinct(F.filter(parts, lambda x: x.isin(*THEMES)))
    return F.when(F.size(known) > 0, F.array_join(known, ";")).otherwise("other")


# What absent columns of the model's labels stand for.
LABEL_DEFAULTS = {"secondary_themes": "", "format": "unclear", "setting": "unknown", "audience_intent": "unknown", "entities": "", "theme_reason": ""}


def model_themes(labels: DataFrame, videos: DataFrame, *, order: str) -> DataFrame:
    """The model's labels of known videos, the last by `order` of each: themes cleaned, absent columns filled.
    Without theme_labels they are made of the primary and the secondary themes."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc(order)))
    out = labels.withColumn("_place", place).where("_place = 1").join(videos.select("video_id"), "video_id", "left_semi")
    out = out.withColumns({c: F.lit(v) for c, v in LABEL_DEFAULTS.items() if c not in out.columns})
    primary = F.col("primary_theme") if "primary_theme" in labels.columns else F.lit("other")
    listed = F.col("theme_labels") if "theme_labels" in labels.columns else F.concat_ws(";", primary, "secondary_themes")
    out = out.withColumns({"primary_theme": clean_theme(F.coalesce(primary, F.lit("other"))), "theme_labels": clean_theme_labels(listed)})
    return out.withColumn("theme_source", F.lit("model")).select("video_id", "primary_theme", "theme_labels", "theme_source", *LABEL_DEFAULTS)


def label_videos(videos: DataFrame, text: Column, labels: DataFrame | None = None, *, order: str = "seq") -> DataFrame:
    """Every video with its themes: the model's where it has a label, else those of words in its text."""
    by_words = classified(videos.withColumn("_text", F.lower(text)), F.col("_text")).withColumn("theme_source",
        F.lit("keyword")).withColumns({c: F.lit(v) for c, v in LABEL_DEFAULTS.items()})
    names = ["video_id", "primary_theme", "theme_labels", "theme_source", *LABEL_DEFAULTS]
    out = by_words.select(*names)
    if labels is not None:
        model = model_themes(labels, videos, order=order)
        out = out.join(model.select("video_id"), "video_id", "left_anti").unionByName(model)
    return out.withColumn("n_theme_labels", F.size(F.split("theme_labels", ";")))


def theme_sources(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("theme_source").agg(F.count("*").alias("n_videos"))


def community_profiles(comments: DataFrame, videos: DataFrame, summary: DataFrame, *, k: int = 5) -> DataFrame:
    """Per community: commenters, comments, videos, the k themes and videos of most commenters as text, and its
    nodes of the graph. comments: with community; summary: (part, n_nodes, pct_nodes)."""
    c = comments.join(videos.select("video_id", "title", "theme"), "video_id", "left")
    out = c.groupBy("community").agg(F.countDistinct("actor_id").alias("n_commenters"), F.count("*").alias("n_comments"),
        F.countDistinct("video_id").alias("n_videos"))

    def top(*label: str) -> DataFrame:
        counts = c.groupBy("community", *label).agg(F.count("*").alias("n_comments"), F.countDistinct("actor_id").alias("n"))
        place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), F.desc("n_comments"), *label))
        shown = F.concat(F.substring(F.col(label[-1]), 1, 48), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
        best = counts.withColumn("_place", place).where(F.col("_place") <= k)
        items = F.array_sort(F.collect_list(F.struct("_place", shown.alias("t"))))
        return best.groupBy("community").agg(F.array_join(items["t"], "; ").alias(f"top_{label[-1]}s"))

    nodes = summary.select(F.col("part").alias("community"), "n_nodes", "pct_nodes")
    return out.join(top("theme"), "community", "left").join(top("video_id", "title"), "community", "left").join(nodes, "community", "left")

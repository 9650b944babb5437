"""Aspect sentiment: units to be scored, rows per (unit, aspect), summaries, days, and days that stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import label_list, last_value, lowered, pairs_list, places, ratio, ratio0

# The aspects, and the words that point to each.
ASPECTS = ("pacing_editing", "commercial_sponsorship", "authenticity_fabrication", "host_persona", "guest_collab",
    "cultural_values_politics", "content_quality_information", "production_quality", "price_value_product", "safety_ethics", "other", "unclear")
ASPECT_KEYWORDS = {
    "pacing_editing": ["拖", "太長", "節奏", "剪輯", "廢話", "冗", "慢", "水", "重複", "pacing", "editing"],
    "commercial_sponsorship": ["業配", "廣告", "贊助", "sponsor", "ad", "置入", "工商", "葉配", "商業", "收錢"],
    "authenticity_fabrication": ["造假", "假", "演", "劇本", "作秀", "騙", "不真實", "設定", "fabricated", "fake", "staged"],
    "host_persona": ["ian", "eric", "主持", "本人", "人設", "個性", "態度", "嘟嘟人", "dodo"],
    "guest_collab": ["來賓", "合作", "collab", "ft", "嘉賓", "super junior", "sj", "藝人"],
    "cultural_values_politics": ["統戰", "政治", "價值觀", "中國", "台灣", "文化", "立場", "辱", "歧視"],
    "content_quality_information": ["內容", "資訊", "沒料", "無聊", "不好看", "品質", "題材", "企劃", "比較", "實測"],
    "production_quality": ["音量", "收音", "字幕", "畫質", "鏡頭", "拍攝", "後製", "音質"],
    "price_value_product": ["價格", "貴", "便宜", "值得", "cp", "功能", "產品", "開箱", "實測", "比較"],
    "safety_ethics": ["危險", "安全", "道德", "不尊重", "違法", "倫理", "受傷", "風險"],
}
SCOPES = ("negative", "positive", "keyword", "negative_or_keyword", "all")


def keyword_aspects(text: Column) -> Column:
    """The aspects one of whose words the text contains in any case, `;`-joined, in order."""
    return lowered(text, lambda t: F.concat_ws(";", *(F.when(_any(t, words), F.lit(aspect)) for aspect, words in ASPECT_KEYWORDS.items())))


def _any(text: Column, words: list[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def comment_units(comments: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """The comments that a scope sends to be scored, with their keyword aspects; comments: label and text."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}; one of {SCOPES}")
    out = comments.withColumn("aspect_keyword_hits", keyword_aspects(F.col(text)))
    label, key = F.col("label"), F.col("aspect_keyword_hits") != ""
    keep = {"negative": label == "negative", "positive": label == "positive", "keyword": key,
        "negative_or_keyword": (label == "negative") | key, "all": F.lit(True)}[scope]
    return out.where(F.coalesce(keep, F.lit(False)))


def external_units(posts: DataFrame) -> DataFrame:
    """Posts as units: their text columns joined by line breaks, engagement as likes, the stance as label."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "text", "body", "content") if c in posts.columns]
    label = F.coalesce(F.col("stance"), F.lit("")) if "stance" in posts.columns else F.lit("")
    return posts.select(F.col("post_uid").cast("string").alias("unit_id"), F.lit("external_post").alias("source_type"), "source",
        F.lit(None).cast("bigint").alias("video_id"), "ts", F.coalesce("engagement", F.lit(0.0)).alias("like_count"), label.alias("label"),
        F.concat_ws("\n", *texts).alias("text"))


def aspect_rows(units: DataFrame) -> DataFrame:
    """(unit_id, aspect, sentiment, severity, confidence) from `a;b`, `a=x;b=y`, `a=0..3` and `a=0..1` lists; a
    missing sentiment is `unclear`, missing numbers are 0, and so is a unit without aspects `unclear`. A unit's first row
    (`leads`) tells whether any of them is negative or positive (`unit_negative`, `unit_positive`)."""
    lists = {"sentiment": "aspect_sentiments", "severity": "aspect_severities", "confidence": "aspect_confidences"}
    maps = units.withColumns({f"_{k}": pairs_list(F.col(c)) for k, c in lists.items()})
    labels = F.coalesce(label_list(F.col("aspect_labels")), F.array().cast("array<string>"))
    maps = maps.withColumn("_labels", F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("unclear"))))
    felt = lambda x: F.coalesce(F.exists("_labels", lambda a: last_value(F.col("_sentiment"), a).isin(x, "mixed")), F.lit(False))
    maps = maps.withColumns({"unit_negative": felt("negative"), "unit_positive": felt("positive")})
    long = maps.select("*", F.posexplode("_labels").alias("_place", "aspect")).withColumn("leads", F.col("_place") == 0).drop("_labels", "_place")
    own = {k: last_value(F.col(f"_{k}"), F.col("aspect")) for k in lists}
    number = lambda k: F.coalesce(own[k].try_cast("double"), F.lit(0.0))
    out = long.withColumns({
        "sentiment": F.coalesce(own["sentiment"], F.lit("unclear")), "severity": number("severity"), "confidence": number("confidence"),
    })
    return out.drop(*(f"_{k}" for k in lists), *lists.values(), "aspect_labels")


def _sides() -> tuple[Column, Column, Column]:
    """Whether a row is negative, or positive, and what it weighs."""
    side = lambda x: F.col("sentiment").isin(x, "mixed")
    return side("negative"), side("positive"), F.coalesce(F.col("like_count"), F.lit(0)) + 1


def aspect_summary(rows: DataFrame, units: DataFrame, full: DataFrame, *, unique: bool = False) -> DataFrame:
    """Per aspect: distinct units, negative and positive ones, their rates, lifts and shares, plain and weighted
    by likes, and mean severity. units: the scored ones with their own label; full: all comments with
    theirs, the denominator of prevalence.

    Rows are added up by unit and aspect first; distinct units are then plain counts. Where unit_id is a key of units
    (`unique`), each row of aspect_rows is one already, and nothing is shuffled but sums.
    """
    negative, positive, weight = _sides()
    flag = lambda c: F.max(c.cast("int"))
    heavy = lambda c: F.sum(F.when(c, weight).otherwise(0))
    if unique:
        zero = lambda c: F.when(c, weight).otherwise(0)
        one = rows.select("aspect", negative.cast("int").alias("neg"), positive.cast("int").alias("pos"), weight.alias("w"), zero(negative).alias("wneg"),
            zero(positive).alias("wpos"), F.col("severity").alias("sev"), F.lit(1).alias("n"))
        by_unit = rows.where("leads").select(F.col("unit_negative").cast("int").alias("neg"), F.col("unit_positive").cast("int").alias("pos"))
    else:
        one = rows.groupBy("unit_id", "aspect").agg(flag(negative).alias("neg"), flag(positive).alias("pos"), F.sum(weight).alias("w"),
            heavy(negative).alias("wneg"), heavy(positive).alias("wpos"), F.sum("severity").alias("sev"), F.count("*").alias("n"))
        by_unit = one.groupBy("unit_id").agg(F.max("neg").alias("neg"), F.max("pos").alias("pos"))
    total = by_unit.agg(F.count("*").alias("_units"), F.greatest(F.sum("neg"), F.lit(1)).alias("_neg"), F.greatest(F.sum("pos"), F.lit(1)).alias("_pos"))
    share = lambda x: F.avg((F.col("label") == x).cast("double"))
    scored = units.agg(share("negative").alias("_sneg"), share("positive").alias("_spos"))
    every = full.agg(F.count("*").alias("_full"), share("negative").alias("_fneg"), share("positive").alias("_fpos"))
    out = one.where("aspect <> 'unclear'").groupBy("aspect").agg(F.count("*").alias("n_units"), F.sum("neg").alias("n_negative"),
        F.sum("pos").alias("n_positive"), F.sum("w").alias("_w"), F.sum("wneg").alias("_wneg"), F.sum("wpos").alias("_wpos"),
        F.sum("sev").alias("_sev"), F.sum("n").alias("_n"))
    out = out.crossJoin(total).crossJoin(scored).crossJoin(every)  # one row each
    columns = {"mention_rate": ratio(F.col("n_units"), F.col("_units")), "mean_severity": ratio(F.col("_sev"), F.col("_n"))}
    for name, x in (("negative", "neg"), ("positive", "pos")):
        n = F.col(f"n_{name}")
        rate, prevalence = ratio0(n, F.col("n_units")), ratio(n, F.col("_full"))
        columns |= {
            f"{name}_rate": rate, f"{name}_lift": ratio(rate, F.col(f"_s{x}")), f"{name}_share": ratio(n, F.col(f"_{x}")),
            f"weighted_{name}_rate": ratio0(F.col(f"_w{x}"), F.col("_w")),
            f"{name}_prevalence": prevalence, f"{name}_prevalence_lift": ratio(prevalence, F.col(f"_f{x}")),
        }
    return out.select("aspect", "n_units", "n_negative", "n_positive", *(places(c).alias(k) for k, c in columns.items()))


def aspect_daily(rows: DataFrame, *platform: str, unique: bool = False) -> DataFrame:
    """Per day and aspect (of each platform): distinct units, negative and positive rows, severity, weight. unique:
    as in aspect_summary."""
    negative, positive, weight = _sides()
    rows = rows.where("aspect <> 'unclear' and ts is not null").withColumn("day", F.to_date("ts"))
    sums = {"neg": F.count_if(negative), "pos": F.count_if(positive), "sev": F.sum("severity"), "n": F.count("*"), "w": F.sum(weight)}
    columns = [c.alias(k) for k, c in sums.items()]
    if unique:
        one = rows.groupBy(*platform, "day", "aspect").agg(F.count("*").alias("n_units"), *columns)
    else:
        one = rows.groupBy(*platform, "day", "aspect", "unit_id").agg(*columns).groupBy(*platform, "day", "aspect").agg(F.count("*").alias("n_units"),
            *(F.sum(k).alias(k) for k in sums))
    return one.select(*platform, "day", "aspect", "n_units", F.col("neg").alias("n_negative"), F.col("pos").alias("n_positive"),
        places(ratio(F.col("sev"), F.col("n"))).alias("mean_severity"), F.col("w").alias("weight"))


def aspect_anomalies(daily: DataFrame, platform: str, *, least: int = 3, sigmas: float = 2.0) -> DataFrame:
    """Days of a platform and aspect with at least mean + 2 sigma (population) negatives, 3 at least."""
    group = Window.partitionBy(platform, "aspect")
    out = daily.withColumns({"mean": F.avg("n_negative").over(group), "sd": F.stddev_pop("n_negative").over(group)})
    threshold = F.greatest(F.col("mean") + sigmas * F.col("sd"), F.lit(float(least)))
    out = out.where(F.col("n_negative") >= threshold)
    return out.select(platform, "aspect", "day", "n_negative", places(F.col("mean")).alias("mean"), places(F.col("sd")).alias("sd"),
        places(ratio(F.col("n_negative") - F.col("mean"), F.col("sd"))).alias("z"), places(threshold).alias("threshold"))


def labelled_aspects(comments: DataFrame, aspects: DataFrame, sentiment: str) -> DataFrame:
    """Comments of a sentiment with the primary aspect of their unit (`other` without one); aspects: (unit_id,
    primary_aspect), of equal ids one."""
    one = aspects.groupBy("unit_id").agg(F.min("primary_aspect").alias("aspect"))
    return comments.where(F.col("label") == sentiment).join(one, "unit_id", "left").withColumn("aspect", F.coalesce("aspect", F.lit("other")))


def aspect_shares(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key's rows, the share of each aspect."""
    out = rows.groupBy(*keys, "aspect").agg(F.count("*").alias("n"))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy(*keys))).withColumn("share", places(ratio(F.col("n"), F.col("total"))))


def top_negative(comments: DataFrame, *, k: int = 3) -> DataFrame:
    """The k most liked negative comments of each video."""
    order = Window.partitionBy("video_id").orderBy(F.desc("like_count"), "ts", "thread_id", "line", "actor_id")
    return comments.where("label = 'negative'").withColumn("place",
        F.row_number().over(order)).where(F.col("place") <= k).select("video_id", "place", "like_count", "ts", "thread_id", "line")


def actionable_share(rows: DataFrame, key: str) -> DataFrame:
    """Of each key's negative rows, the share on aspects other than `other` and `unclear`."""
    neg = rows.where("sentiment = 'negative'")
    return neg.groupBy(key).agg(F.count("*").alias("n"), places(ratio(F.count_if(~F.col("aspect").isin("other", "unclear")), F.count("*"))).alias("actionable"))

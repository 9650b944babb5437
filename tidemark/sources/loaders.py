"""Source relations by their stored schemas: channels, videos, comments, labels, outside posts.

Readers take DataFrames of the raw relations (read with sources.views.read_table or any Spark
source) and return typed, filtered ones; predicates stay on stored columns so that they reach
the scan. Text that does not parse becomes null, never an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import channel_key, duration_seconds, first_line
from tidemark.plans.tables import written


@dataclass(frozen=True)
class Scope:
    """What a report covers; dates are half open."""

    channel_id: str
    date_start: str | None = None
    date_end: str | None = None
    include_replies: bool = False
    exclude_shorts: bool = True
    short_seconds: int = 180


def parse_config(text: str) -> dict:
    """A YAML subset of two levels: `key: value`, indented maps, quotes, numbers, booleans, null."""
    out: dict = {}
    inner: dict | None = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = line.strip().partition(":")
        value = value.strip()
        if raw[0] in " \t" and inner is not None:
            inner[key] = _scalar(value)
        elif value:
            out[key], inner = _scalar(value), None
        else:
            out[key] = inner = {}
    return out


def _scalar(value: str):
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        return value[1:-1]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    if value.lower() in ("null", "~", "none", ""):
        return None
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def text_list(value) -> list[str]:
    """A list, or a text cut at `;` or `,`, as trimmed texts without blanks."""
    parts = value if isinstance(value, (list, tuple)) else re.split("[;,]", str(value or ""))
    return [t for t in (str(p).strip() for p in parts) if t]


SOURCES = ("forum_a", "forum_b")


@dataclass(frozen=True)
class Config:
    """A typed configuration: the scope of a report, thresholds by name, outside sources."""

    project_name: str
    scope: Scope
    analysis: dict
    run_slug: str
    sources: tuple[str, ...]
    aliases: tuple[str, ...]


def load_config(text: str) -> Config:
    """A configuration from its text; fails without a project name or a channel, on numbers that are none,
    and on unknown sources."""
    raw = parse_config(text)
    if not raw.get("project_name") or not (raw.get("channel_id") or raw.get("channel_handle") or raw.get("channel_url")):
        raise ValueError("a configuration needs project_name and one of channel_id, channel_handle, channel_url")
    optional = lambda k: (str(raw[k]).strip() or None) if raw.get(k) not in (None, "") else None
    analysis = raw.get("analysis") or {}
    wrong = sorted(k for k, v in analysis.items() if not isinstance(v, (int, float, str)) or isinstance(v, bool))
    if wrong:
        raise ValueError(f"thresholds that are no values: {wrong}")
    outside = raw.get("external_analysis") or {}
    sources = tuple(text_list(outside.get("sources") or SOURCES[0]))
    if unknown := sorted(set(sources) - set(SOURCES)):
        raise ValueError(f"unknown sources {unknown}; known are {SOURCES}")
    channel = str(raw.get("channel_id") or raw.get("channel_handle") or raw.get("channel_url"))
    scope = Scope(channel, optional("date_start"), optional("date_end"), bool(raw.get("include_replies")),
        raw.get("exclude_shorts") is not False, int(raw.get("short_threshold_seconds") or 180))
    named = slug(str((raw.get("outputs") or {}).get("run_slug") or raw["project_name"]))
    return Config(str(raw["project_name"]), scope, analysis, named, sources,
        tuple(channel_aliases(*text_list(outside.get("channel_aliases")), raw.get("channel_handle"))))


def slug(text: str) -> str:
    """Lower case, runs of other than letters and digits as one hyphen."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def resolve_channel(channels: DataFrame, handle: str) -> DataFrame:
    """The first channel by id whose id is the handle, whose URL contains it or whose title equals it."""
    wanted = handle.lower().lstrip("@")
    rank = F.when(F.col("channel_id") == handle, 0).when(F.contains(F.lower("custom_url"), F.lit(wanted)), 1).when(F.lower("title") == wanted, 2)
    return channels.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "channel_id").limit(1).drop("_rank")


def load_videos(videos: DataFrame, scope: Scope) -> DataFrame:
    """The channel's videos in the dates, shorts left out where asked for."""
    out = videos.where(F.col("owner_channel_id") == scope.channel_id)
    if scope.date_start:
        out = out.where(F.col("published_at") >= F.lit(scope.date_start).cast("timestamp"))
    if scope.date_end:
        out = out.where(F.col("published_at") < F.lit(scope.date_end).cast("timestamp"))
    out = out.withColumn("duration_seconds", duration_seconds(F.col("duration")))
    return out.where(F.col("duration_seconds") > scope.short_seconds) if scope.exclude_shorts else out


def load_comments(comments: DataFrame, videos: DataFrame, actors: DataFrame, scope: Scope) -> DataFrame:
    """Comments with an author on the scope's videos, with the author's name."""
    out = comments.where("author_actor_id is not null")
    if not scope.include_replies:
        out = out.where("is_top_level = 1")
    out = out.join(videos.select("video_id"), "video_id", "left_semi")
    names = actors.select(F.col("actor_id").alias("author_actor_id"), F.col("latest_display_name").alias("name"))
    return out.withColumn("like_count", F.coalesce(F.col("like_count").cast("bigint"), F.lit(0))).join(names, "author_actor_id", "left")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last by order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def load_sentiment(labels: DataFrame, comments: DataFrame) -> DataFrame:
    """Model labels that parsed, of known comments, with label and weight (likes and one)."""
    missing = {"comment_id", "sentiment_label", "sentiment_parse_error"} - set(labels.columns)
    if missing:
        raise ValueError(f"label relation lacks {sorted(missing)}")
    good = labels.where(~F.coalesce(F.lower(F.col("sentiment_parse_error").cast("string")).isin("true", "1", "yes"), F.lit(False)))
    own = F.lower(F.trim("sentiment_label"))
    good = good.select("comment_id", F.when(own.isin("negative", "positive"), own).otherwise("neutral").alias("label"),
        *(F.expr(f"try_cast({c} as double)").alias(c) for c in ("score_neg", "score_neu", "score_pos") if c in labels.columns))
    return good.join(comments, "comment_id").withColumn("weight", F.coalesce("like_count", F.lit(0)) + 1)


def short_date(text: Column) -> Column:
    """`YY/MM/DD HH:MM` anywhere in a text, as a timestamp of this century."""
    at = lambda i: F.nullif(F.regexp_extract(text, r"(\d{2})/(\d{2})/(\d{2}) (\d{2}):(\d{2})", i), F.lit("")).cast("int")
    return F.try_make_timestamp(2000 + at(1), at(2), at(3), at(4), at(5), F.lit(0))


def header_date(text: Column) -> Column:
    """The date of a body's header line, `時間 Www Mon d HH:MM:SS yyyy`."""
    at = lambda i: F.regexp_extract(text, r"時間\s+\w{3}\s+(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})", i)
    return F.try_to_timestamp(F.concat_ws(" ", at(4), at(1), F.lpad(at(2), 2, "0"), at(3)), F.lit("yyyy MMM dd HH:mm:ss"))


def undated(text: Column) -> Column:
    """(month, day, hour, minute) of `M 月 D 日 HH:MM` in a text; null without one."""
    at = lambda i: F.nullif(F.regexp_extract(text, r"(\d{1,2}) 月 (\d{1,2}) 日 (\d{1,2}):(\d{2})", i), F.lit("")).cast("int")
    return F.when(at(1).isNotNull(), F.struct(at(1).alias("month"), at(2).alias("day"), at(3).alias("hour"), at(4).alias("minute")))


def with_inferred_dates(posts: DataFrame, *, first: int = 2018, last: int = 2027) -> DataFrame:
    """posts (id bigint, ts or null, parts: what `undated` finds) with ts filled: the first year for which the
    date lies between the latest date of lower ids and the earliest of higher ids; if there is none, the
    year nearest to any dated post. Posts without parts stay undated.

    Ids are sorted by range; bounds are put together from those in a range and those of the ranges
    before and after it, of which there is one row each.
    """
    rows = written(posts.repartitionByRange("id").sortWithinPartitions("id").withColumn("_part", F.spark_partition_id()), "posts")
    ranges = rows.groupBy("_part").agg(F.max("ts").alias("_max"), F.min("ts").alias("_min"))
    order = Window.orderBy("_part")  # one row for each range
    ranges = ranges.select("_part", F.max("_max").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_min").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    own = Window.partitionBy("_part").orderBy("id")
    rows = rows.withColumns({"_low": F.max("ts").over(own.rangeBetween(Window.unboundedPreceding, -1)),
        "_high": F.min("ts").over(own.rangeBetween(1, Window.unboundedFollowing))})
    days = posts.agg(F.collect_set(F.to_date("ts")).alias("_days"))  # one row, at most the days of the calendar
    rows = rows.join(ranges, "_part").crossJoin(days)
    low, high = F.greatest("_low", "_before"), F.least("_high", "_after")
    years = F.sequence(F.lit(first), F.lit(last))
    dates = F.filter(F.transform(years, lambda y: F.try_make_timestamp(y, F.col("parts.month"), F.col("parts.day"), F.col("parts.hour"),
        F.col("parts.minute"), F.lit(0))), lambda t: t.isNotNull())
    inside = F.filter(dates, lambda t: (low.isNull() | (t >= low)) & (high.isNull() | (t <= high)))
    gap = lambda t: F.array_min(F.transform("_days", lambda d: F.abs(F.date_diff(F.to_date(t), d))))
    nearest = F.array_min(F.transform(dates, lambda t: F.struct(gap(t).alias("gap"), t.alias("t"))))["t"]
    found = F.when(F.size(inside) > 0, F.try_element_at(inside, F.lit(1))).when(F.size("_days") > 0, nearest)
    inferred = F.col("ts").isNull() & F.col("parts").isNotNull()
    out = rows.withColumns({"ts": F.when(inferred, found).otherwise(F.col("ts")), "date_quality": F.when(inferred, "inferred").otherwise("explicit")})
    return out.select(*posts.columns, "date_quality")


POST_SCHEMA = "post_uid string, source string, post_id string, ts timestamp, date_quality string, day date, title string, url string, text string, engagement bigint"


def empty_posts(spark) -> DataFrame:
    return spark.createDataFrame([], POST_SCHEMA)


def source_mismatch(manifest: dict, channel_id: str) -> str:
    """What is wrong if the outside sources were gathered for another channel; empty if nothing is."""
    found = str((manifest.get("metadata") or {}).get("channel_id") or "").strip()
    wanted = channel_id.strip()
    return f"sources belong to channel {found}, not to {wanted}" if found and wanted and found != wanted else ""


def load_posts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Posts of two forums (see FIXTURES.md) as one relation; undated posts go, of equal uids the last stays.
    Posts of the second forum whose year is not written take it from their neighbours by id."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = lambda *ids: F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ids))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))
    a = first.select(F.lit("forum_a").alias("source"), key("url", "title").alias("post_id"), header_date(F.col("body")).alias("ts"),
        F.lit("explicit").alias("date_quality"), text("title").alias("title"), F.col("url"),
        F.concat_ws("\n", "title", "body").alias("text"), (number("comment_count") + number("pushes") + number("boos")).alias("engagement"))
    title = F.coalesce(F.nullif(text("title"), F.lit("")), first_line(F.col("content")), F.lit(""))
    b = second.select("*", title.alias("_title"), F.trim(F.concat_ws("\n", title, text("content"))).alias("text"))
    b = b.select(F.expr("try_cast(id as bigint)").alias("id"), key("id", "url", "title").alias("post_id"),
        F.coalesce(short_date(F.col("created_at")), short_date(F.col("text"))).alias("ts"), undated(F.col("text")).alias("parts"),
        F.col("_title").alias("title"), F.col("url"), "text", (number("like_count") + number("comment_count")).alias("engagement"))
    b = with_inferred_dates(b).select(F.lit("forum_b").alias("source"), "post_id", "ts", "date_quality", "title", "url", "text", "engagement")
    dated = a.unionByName(b).where("ts is not null").withColumns({"post_uid": F.concat_ws(":", "source", "post_id"), "day": F.to_date("ts")})
    return keep_last(dated, "post_uid", "ts").select(*(x.split()[0] for x in POST_SCHEMA.split(", ")))


def channel_aliases(*names: str | None) -> list[str]:
    """Names that a post may call the channel by: trimmed, without @, first of equals."""
    out: dict[str, str] = {}
    for name in names:
        text = (name or "").strip()
        if text:
            out.setdefault(" ".join(text.lower().lstrip("@").split()), text.lstrip("@"))
    return [v for k, v in out.items() if k]


def load_cohort(rows: DataFrame, *, status: str, wanted: str = "O") -> DataFrame:
    """Cohort rows of the wanted status with the key of their URL; fails without the columns it needs."""
    missing = {"candidate_id", "channel_name", "url", status} - set(rows.columns)
    if missing:
        raise ValueError(f"cohort relation lacks {sorted(missing)}")
    return rows.where(F.trim(status) == wanted).withColumn("key", channel_key(F.col("url")))


def page(rows: DataFrame, limit: int, *, least: int = 1, most: int = 5000) -> tuple[DataFrame, int]:
    """The first rows, their number clamped, and how many there are."""
    return rows.limit(max(least, min(most, limit))), rows.count()


def write_outputs(frames: dict[str, DataFrame], folder: str) -> list[str]:
    """Each relation as a CSV folder of its name; the paths in order."""
    paths = []
    for name, df in frames.items():
        write_csv(df, f"{folder}/{name}.csv")
        paths.append(f"{folder}/{name}.csv")
    return paths


def report_payload(frames: dict[str, DataFrame], *, rows: int = 20) -> dict[str, list[dict]]:
    """The first rows of each relation as plain values: what a report shows, never whole relations."""
    import math

    plain = lambda x: None if isinstance(x, float) and not math.isfinite(x) else x.isoformat() if hasattr(x, "isoformat") else x
    return {name: [{k: plain(x) for k, x in r.asDict().items()} for r in df.limit(rows).collect()] for name, df in frames.items()}


def read_reports(spark, pattern: str) -> DataFrame:
    """Many JSON reports as one relation, each with the path that it came from."""
    return spark.read.option("multiLine", "true").json(pattern).withColumn("path", F.input_file_name())


def sha256_of(path: str) -> str:
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_checksum(path: str, wanted: str | None) -> None:
    """Fails if a file's SHA-256 is not the wanted one (nothing is wanted: nothing to check)."""
    if wanted and (found := sha256_of(path)) != wanted.strip().lower():
        raise ValueError(f"{path} has checksum {found}, not {wanted}")


def aliased(posts: DataFrame, aliases: list[str]) -> DataFrame:
    """Posts with alias_hit: any normalised alias within title and text."""
    from tidemark.functions.columns import hits, normalized

    words = [w for w in (" ".join(a.lower().split()) for a in aliases) if w]
    hit = hits(normalized(F.concat_ws(" ", "title", "text")), words) > 0 if words else F.lit(False)
    return posts.withColumn("alias_hit", hit)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV sink with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON-lines sink; NaN and infinities become null."""
    finite = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    df.withColumns(finite).write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, *, rows: int = 20) -> None:
    """The first rows as a Markdown table in text files, one partition."""
    shown = df.limit(rows)
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)], "value string")
    head.unionByName(shown.select(cells.alias("value"))).coalesce(1).write.mode("overwrite").text(path)

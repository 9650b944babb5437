"""The base report: videos, actors, tiers, and how actors return from block to block of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import places, ratio
from tidemark.plans.tables import numbered

TIERS = ("core", "regular", "returning", "one_time")


def video_metrics(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Every video with what its comments add up to; videos without comments have 0."""
    own = comments.groupBy("video_id").agg(F.count("*").alias("n_comments"), F.countDistinct("actor_id").alias("n_commenters"),
        F.sum("like_count").alias("likes"), F.max("ts").alias("last_comment_at"))
    out = videos.join(own, "video_id", "left")
    return out.select("video_id", "title", "theme", "published_at", F.date_format("published_at", "yyyy-MM").alias("month"), "view_count",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_comments", "n_commenters", "likes")), "last_comment_at")


def channel_overview(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """One row of totals; sums over nothing are 0."""
    first = videos.agg(F.count("*").alias("n_videos"), F.min("published_at").alias("first_video_at"),
        F.max("published_at").alias("last_video_at"), F.coalesce(F.sum("view_count"), F.lit(0)).alias("views"))
    second = comments.agg(F.count("*").alias("n_comments"), F.countDistinct("actor_id").alias("n_commenters"),
        F.coalesce(F.sum("like_count"), F.lit(0)).alias("likes"))
    return first.crossJoin(second)  # one row each


def commenter_activity(comments: DataFrame, actors: DataFrame) -> DataFrame:
    own = comments.groupBy("actor_id").agg(F.count("*").alias("n_comments"), F.countDistinct("video_id").alias("n_videos"),
        F.sum("like_count").alias("likes"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return own.join(actors.select("actor_id", "name"), "actor_id", "left")


def with_tiers(activity: DataFrame, videos: DataFrame, *, core: float = 0.05, regular: float = 0.02, core_videos: int = 3) -> DataFrame:
    """activity with coverage of all videos and the tier; the first rule that holds decides."""
    total = videos.agg(F.count("*").alias("_total"))
    out = activity.crossJoin(total).withColumn("coverage", ratio(F.col("n_videos"), F.col("_total"))).drop("_total")
    tier = F.when(F.col("n_videos") <= 1, "one_time").when((F.col("coverage") >= core) & (F.col("n_videos") >= core_videos),
        "core").when(F.col("coverage") >= regular, "regular").otherwise("returning")
    return out.withColumn("tier", tier)


def first_known(rows: DataFrame, by: str, order: list[str], *columns: str) -> DataFrame:
    """(by, columns): of each column its first value, by order, that is not null; null where there is none."""
    return rows.groupBy(by).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns))


def retiered(stored: DataFrame, sizes: DataFrame, run: str = "run", *, core: float = 0.05, regular: float = 0.02, core_videos: int = 3) -> DataFrame:
    """Tiers of stored runs made again from what they hold: activity (run, actor_id, n_comments, n_videos, likes) and sizes
    (run, n_total). A run without videos has coverage 0."""
    cover = F.coalesce(ratio(F.col("n_videos"), F.col("n_total")), F.lit(0.0))
    tier = F.when(F.col("n_videos") <= 1, "one_time").when((cover >= core) & (F.col("n_videos") >= core_videos), "core").when(cover >= regular,
        "regular").otherwise("returning")
    out = stored.join(sizes, run, "left").groupBy(run, tier.alias("tier")).agg(F.count("*").alias("n_commenters"), places(F.avg("n_videos")).alias("mean_videos"),
        F.percentile("n_videos", 0.5).alias("median_videos"), F.sum("n_comments").alias("comments"), F.sum("likes").alias("likes"))
    return out.withColumn("pct_commenters", places(100 * ratio(F.col("n_commenters"), F.sum("n_commenters").over(Window.partitionBy(run)))))


def commenter_tiers(tiered: DataFrame) -> DataFrame:
    out = tiered.groupBy("tier").agg(F.count("*").alias("n_commenters"), F.avg("n_comments").alias("mean_comments"),
        F.percentile("n_videos", 0.5).alias("median_videos"), F.sum("n_comments").alias("comments"), F.sum("likes").alias("likes"))
    everyone = Window.partitionBy()
    return out.select("tier", "n_commenters", places(F.col("mean_comments")).alias("mean_comments"), "median_videos", "comments", "likes",
        places(100 * ratio(F.col("n_commenters"), F.sum("n_commenters").over(everyone))).alias("pct_commenters"))


def placed(videos: DataFrame, *by: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, video_id, i, n): the place of each video in order of publication (of each `by`), and how many; and what is to
    be kept. Videos that have their places already are taken as they are."""
    if {"i", "n"} <= set(videos.columns):
        return videos.select(*by, "video_id", "i", "n", *keep)
    order = [F.col("published_at").asc_nulls_last(), F.col("video_id")]
    if not by:
        return numbered(videos.select("video_id", "published_at"), *order, name="i").select("video_id", "i", F.col("_rows").alias("n"))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return videos.select(*by, "video_id", i.alias("i"), F.count("*").over(Window.partitionBy(*by)).alias("n"), *keep)


def continuity(actor_videos: DataFrame, videos: DataFrame, windows: int | tuple[int, ...] = 4, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Videos by publication in blocks of near-equal count, for each number of windows; actors of each
    block, and those of them who are in the next. Facts are read once for all numbers of windows."""
    options = (windows,) if isinstance(windows, int) else windows
    held = placed(videos, *by).withColumn("n_windows", F.explode(F.array(*map(F.lit, options))))
    size, more = F.call_function("div", F.col("n"), F.col("n_windows").cast("long")), F.col("n") % F.col("n_windows")
    # the first `more` blocks have one video more than the others
    cut = more * (size + 1)
    late = more + F.call_function("div", F.col("i") - cut, F.greatest(size, F.lit(1).cast("long")))
    block = F.when(F.col("i") < cut, F.call_function("div", F.col("i").cast("long"), size + 1)).otherwise(late).cast("int")
    seen = actor_videos.join(held.select(*by, "video_id", "n_windows", block.alias("block")), [*by, "video_id"]).select(*by, "n_windows",
        "block", "actor_id").distinct()
    # a pair of blocks is one group: an actor of the block, and the same actor of the next
    both = seen.select(*by, "n_windows", "actor_id", F.explode(F.array(F.struct("block", F.lit(True).alias("base")),
        F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("base")))).alias("x"))
    one = both.groupBy(*by, "n_windows", "x.block", "actor_id").agg(F.max("x.base").alias("base"), F.max(~F.col("x.base")).alias("next"))
    out = one.where((F.col("block") >= 0) & (F.col("block") < F.col("n_windows") - 1)).groupBy(*by, "n_windows",
        "block").agg(F.count_if("base").alias("n_base"), F.count_if(F.col("base") & F.col("next")).alias("n_returned"))
    return out.where("n_base > 0").select(*by, "n_windows", "block", "n_base", "n_returned",
        places(ratio(F.col("n_returned"), F.col("n_base"))).alias("return_rate"))


def parse_windows(text: str, *, least: int = 2) -> tuple[int, ...]:
    """Window counts of a text like `3,4;6`: whole numbers of at least `least`, each once, in order."""
    found = [int(x) for x in text.replace(";", ",").split(",") if x.strip().isdigit()]
    return tuple(sorted({n for n in found if n >= least}))


def continuity_sensitivity(actor_videos: DataFrame, videos: DataFrame, options: tuple[int, ...] = (3, 4, 6, 8), *, by: tuple[str, ...] = ()) -> DataFrame:
    every = continuity(actor_videos, videos, options, by=by)
    rate = ratio(F.col("n_returned"), F.col("n_base"))
    out = every.groupBy(*by, "n_windows").agg(F.count("*").alias("n_transitions"), F.sum("n_base").alias("n_base"),
        ratio(F.sum("n_returned"), F.sum("n_base")).alias("weighted"), F.percentile(rate, 0.5).alias("median"), F.min(rate).alias("least"),
        F.max(rate).alias("most"))
    return out.select(*by, "n_windows", "n_transitions", "n_base", *(places(F.col(c)).alias(f"{c}_return_rate") for c in ("weighted",
        "median", "least", "most")))


def rolling_retention(actor_videos: DataFrame, videos: DataFrame, *, pre: int = 50, post: int = 50, step: int = 25, by: tuple[str, ...] = ()) -> DataFrame:
    """At each cutoff: actors of the `pre` videos from there, of the `post` videos after those, and
    of both. Each video is sent to the cutoffs that hold it, so that there is no range join."""
    held = placed(videos, *by).withColumn("last", F.col("n") - pre - post).where("last >= 0")
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (pre + post) + 1) / step)).cast("int")
    # pairs meet their video's place first; what goes to several cutoffs is (actor, cutoff)
    seen = actor_videos.join(held, [*by, "video_id"]).withColumn("k", F.explode(F.sequence(first,
        F.greatest(first, F.floor(F.least("i", "last") / step).cast("int"))))).withColumn("cutoff", F.col("k") * step)
    seen = seen.where("cutoff <= i and cutoff <= last and i < cutoff + %d" % (pre + post))
    base = F.col("i") < F.col("cutoff") + pre
    seen = seen.groupBy(*by, "cutoff", "actor_id").agg(F.max(base).alias("base"), F.max(~base).alias("future"))
    out = seen.groupBy(*by, "cutoff").agg(F.count_if("base").alias("n_base"), F.count_if("future").alias("n_future"),
        F.count_if(F.col("base") & F.col("future")).alias("n_returned"))
    return out.select(*by, "cutoff", "n_base", "n_future", "n_returned", places(ratio(F.col("n_returned"), F.col("n_base"))).alias("return_rate"))


def with_profiles(rows: DataFrame, activity: DataFrame, *, key: str = "node") -> DataFrame:
    """rows with what is known of their actors: name, comments, videos, likes."""
    own = activity.select(F.col("actor_id").alias(key), "name", "n_comments", "n_videos", "likes")
    return rows.join(own, key, "left")

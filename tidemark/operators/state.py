"""Work in progress: what is done, what remains, the queue's states, and how long it may take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import duration_seconds_with_days, places, ratio, truthy
from tidemark.sources.keyed import Rule

# Units a minute (low, high) and seconds before the first unit, by stage.
RATES = {"sentiment": (450, 650, 60), "video": (20, 40, 60), "crawl_videos": (20, 60, 30), "crawl_comments": (500, 1500, 30)}


def remaining(wanted: DataFrame, done: DataFrame, key: str, *, error: str | None = None) -> DataFrame:
    """Rows whose key has no result, or only results that did not parse."""
    good = done.where(~truthy(F.col(error))) if error else done
    return wanted.join(good.select(key), key, "left_anti")


def queue_status(queue: DataFrame) -> DataFrame:
    """Rows, videos and errors by status."""
    return queue.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("n_videos"),
        F.count("last_error").alias("n_errors"), F.max("updated_at").alias("last_update"))


def reset_stale(queue: DataFrame, now: str, *, minutes: int = 60, words: tuple[str, ...] = ("quota",)) -> DataFrame:
    """The queue with failures of these words, and resolutions older than so many minutes, queued."""
    failed = (F.col("status") == "failed") & F.coalesce(F.lower("last_error").rlike("|".join(words)), F.lit(False))
    old = (F.col("status") == "resolving") & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    out = queue.withColumn("_again", F.coalesce(failed | old, F.lit(False)))
    keep = lambda c, other: F.when(F.col("_again"), other).otherwise(F.col(c))
    return out.withColumns({"last_error": keep("last_error", F.lit(None)), "updated_at": keep("updated_at", F.lit(now).cast("timestamp")),
        "status": keep("status", F.lit("queued"))}).drop("_again")


def completion_by(wanted: DataFrame, done: DataFrame, key: str, *, error: str) -> DataFrame:
    """One row: expected, completed, failed and remaining keys."""
    own = done.groupBy(key).agg(F.max((~truthy(F.col(error))).cast("int")).alias("_good"))
    out = wanted.select(key).distinct().join(own, key, "left").agg(F.count("*").alias("expected"),
        F.count_if(F.col("_good") == 1).alias("completed"), F.count_if(F.col("_good") == 0).alias("failed"))
    return out.select("*", (F.col("expected") - F.col("completed")).alias("remaining"), places(ratio(F.col("completed"), F.col("expected"))).alias("share"))


def runtime_estimates(counts: DataFrame) -> DataFrame:
    """(stage, units) with the least and most seconds that the units may take."""
    spark = counts.sparkSession
    rates = spark.createDataFrame([(k, *v) for k, v in RATES.items()], "stage string, low_rate int, high_rate int, start int")
    out = counts.join(F.broadcast(rates), "stage")
    some = lambda c: F.when(F.col("units") > 0, F.col("start") + F.ceil(60.0 * F.col("units") / F.col(c))).otherwise(0).cast("bigint")
    return out.select("stage", "units", some("high_rate").alias("low_seconds"), some("low_rate").alias("high_seconds"))


def final_estimate(videos: int, comments: int) -> tuple[float, float]:
    """Seconds of the last stage, low and high."""
    return 15 + 0.02 * videos + 0.0004 * comments, 45 + 0.08 * videos + 0.0012 * comments


def requeue_candidates(videos: DataFrame, queue: DataFrame, channel: str, *, published_after=None, shorts: bool = False, threshold: int = 180) -> DataFrame:
    """(video_id, queue_id, status, action, is_short) of a channel's videos: those to queue again (`update`), those
    that the queue has not (`insert`), and short ones, which are left out (`skip`) unless `shorts`."""
    own = videos.where(F.col("channel_id") == channel)
    if published_after is not None:
        own = own.where(F.col("published_at") >= F.lit(published_after).cast("timestamp"))
    rows = queue.select("video_id", F.col("id").alias("queue_id"), "status")
    seconds = duration_seconds_with_days(F.col("duration"))
    short = F.coalesce(seconds < threshold, F.lit(False))
    action = F.when(F.col("is_short") & F.lit(not shorts), "skip").when(F.col("queue_id").isNull(), "insert").otherwise("update")
    return own.select("video_id", short.alias("is_short")).join(rows, "video_id", "left").select("video_id", "queue_id", "status",
        action.alias("action"), "is_short")


def requeue_counts(candidates: DataFrame) -> DataFrame:
    """Videos by action and by their status before (`missing_queue_row` for none)."""
    return candidates.groupBy("action", F.coalesce("status", F.lit("missing_queue_row")).alias("status")).agg(F.count("*").alias("n"))


def requeue_batch(candidates: DataFrame, now) -> DataFrame:
    """The rows to merge into the queue: a queue may hold a video more than once, a batch has it once."""
    wanted = candidates.where("action <> 'skip'").select("video_id").distinct()
    return wanted.select("video_id", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("video_id").cast("string")).alias("url"),
        F.lit("queued").alias("status"), F.lit(None).cast("string").alias("last_error"), F.lit(now).cast("timestamp").alias("updated_at"))


def requeue_rule(states: tuple[str, ...] = ()) -> Rule:
    """Rows that are there are queued without an error and keep their other columns, those in `states` only if
    any are named; others are put in."""
    where = F.col("old.status").isin(*states) if states else None
    given = {c: F.col(f"new.{c}") for c in ("status", "last_error", "updated_at")}
    return Rule(where=where, update=given, replace=False)


def stored_by_key(rows: DataFrame, name: str, key: str, *, path: str, buckets: int = 32) -> DataFrame:
    """rows as a table of the session's catalogue in `buckets` by key. Two such tables of as many buckets
    join on the key without a shuffle of either."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def attached_by_key(spark: SparkSession, schema: str, name: str, key: str, *, path: str, buckets: int = 32) -> DataFrame:
    """A table that another session stored by key, under a name of this one's catalogue."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)

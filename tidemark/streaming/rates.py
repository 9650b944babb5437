"""The daily relations over streams: the same measures, with watermarks for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(posts: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ts; a table as it is."""
    return posts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if posts.isStreaming else posts


def daily_counts(posts: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Posts of each day and topic: tumbling windows. On a stream, days are final when the
    watermark has passed them; on a table the same plan is a batch aggregate."""
    seen = watermarked(posts, late)
    out = seen.groupBy(F.window("ts", "1 day"), "topic").agg(F.count("*").alias("n_posts"), F.sum("engagement").alias("engagement"))
    return out.select(F.to_date("window.start").alias("day"), "topic", "n_posts", F.round("engagement", 2).alias("engagement"))


def sessions(posts: DataFrame, *, gap: str = "3 hours", late: str = "2 days") -> DataFrame:
    """Runs of an author's posts with no gap of more than `gap` between them."""
    seen = watermarked(posts, late)
    out = seen.groupBy(F.session_window("ts", gap), "author").agg(F.count("*").alias("n_posts"))
    return out.select("author", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n_posts")


def deduplicated(posts: DataFrame, *, late: str = "2 days") -> DataFrame:
    """First arrivals of each event id within the watermark."""
    return watermarked(posts, late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_sink(path: str, key: str, order: str, *, buckets: int = 32):
    """A foreachBatch function that keeps the last row of each key in a keyed table; a batch rewrites the
    buckets that it touches, and one that is run again changes nothing."""

    def put(batch: DataFrame, epoch: int) -> None:
        from tidemark.sources.keyed import KeyedTable, keep_last

        table = KeyedTable(batch.sparkSession, path)
        if not table.versions():
            table.create(batch.limit(0), key, buckets=buckets)
        table.merge(batch, keep_last(order), epoch=epoch, order=order)

    return put


def sliding_counts(posts: DataFrame, *, size: str = "6 hours", step: str = "2 hours", late: str = "2 days") -> DataFrame:
    """Posts of each topic in windows that overlap: a post counts in each that holds it."""
    seen = watermarked(posts, late)
    out = seen.groupBy(F.window("ts", size, step), "topic").agg(F.count("*").alias("n_posts"))
    return out.select(F.col("window.start").alias("started_at"), F.col("window.end").alias("ended_at"), "topic", "n_posts")


def followed_by(first: DataFrame, second: DataFrame, *, within: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Pairs of posts of one author, the second up to `within` after the first: an interval join. On streams
    both sides have watermarks, so that state older than the interval goes."""
    a = watermarked(first, late).select(F.col("author").alias("author"), F.col("ts").alias("first_at"), F.col("event_id").alias("first_id"))
    b = watermarked(second, late).select(F.col("author").alias("_author"), F.col("ts").alias("second_at"), F.col("event_id").alias("second_id"))
    on = (F.col("author") == F.col("_author")) & (F.col("second_at") > F.col("first_at")) & (F.col("second_at") <= F.col("first_at") + F.expr(f"interval {within}"))
    return a.join(b, on).drop("_author")


def append_sink(path: str):
    """A foreachBatch function that appends each batch to a history, once: a batch that is run again
    replaces what it wrote."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return put

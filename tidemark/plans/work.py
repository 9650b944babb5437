"""Relations of work in progress: the queue as a state machine, requeued videos, and results stored by key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import lookup, state
from tidemark.plans.registry import query
from tidemark.plans.tables import shared_dir
from tidemark.sources.keyed import KeyedTable
from tidemark.streaming import queue

NOW = "2024-02-15 00:00:00"


def queue_events(v):
    """The events' table as events of a work queue, a row for each user."""
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.when(k % 5 == 0, "queued").when(k % 5 == 1, "resolving").when(k % 5 == 2, "graphed").when(k % 5 == 3, "failed").otherwise("reset_quota")
    error = F.when(k % 5 == 3, F.when(k % 2 == 0, "HTTP 403 quotaExceeded").otherwise("timeout"))
    return v.table("events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), event.alias("event"),
        error.alias("last_error"), F.when((k % 5 == 1) & (k % 3 == 0), F.concat(F.lit("b"), k.cast("string"))).alias("bundle_id"))


@query
def queue_replayed(v):
    return queue.replayed(queue_events(v), NOW)


@query
def queue_transitions(v):
    return queue.transitions(queue_events(v))


def channel_videos(v):
    """Parts as videos of the channels that their brands are."""
    k = F.col("p_partkey")
    length = F.when(k % 11 == 0, "P1DT2H").when(k % 13 == 0, "live").otherwise(F.concat(F.lit("PT"), (F.col("p_size") % 9).cast("string"), F.lit("M"), (k % 60).cast("string"), F.lit("S")))
    return v.table("part").select(k.alias("video_id"), F.col("p_brand").alias("channel_id"), length.alias("duration"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")).cast("timestamp").alias("published_at"))


def video_queue(v):
    """Three in four videos as rows of a queue."""
    k = F.col("p_partkey")
    status = F.element_at(F.array(*(F.lit(s) for s in queue.STATES)), (F.col("p_size") % 4 + 1).cast("int"))
    return v.table("part").where(k % 4 != 0).select(k.alias("video_id"), (k + 1000).alias("id"), F.concat(F.lit("u/"), k.cast("string")).alias("url"), status.alias("status"),
        F.when(status == "failed", "timeout").alias("last_error"), F.lit("2023-01-01").cast("timestamp").alias("updated_at"))


def _candidates(v):
    return state.requeue_candidates(channel_videos(v), video_queue(v), "Brand#7", published_after="2020-06-01")


@query
def requeue_candidates(v):
    return _candidates(v)


@query
def requeue_counts(v):
    return state.requeue_counts(_candidates(v))


def _requeued(v, rule):
    table = KeyedTable(v.spark, f"{shared_dir(v.spark)}/queue-{uuid.uuid4().hex}").create(video_queue(v), "video_id", buckets=8)
    table.merge(state.requeue_batch(_candidates(v), NOW), rule, epoch=0)
    return table.read()


@query
def queue_after_requeue(v):
    """The queue's table after the merge of a channel's videos."""
    return _requeued(v, state.requeue_rule())


@query
def queue_after_requeue_of_failed(v):
    """As before, where rows that are there are touched only if they failed or were done."""
    return _requeued(v, state.requeue_rule(("failed", "graphed")))


@query
def remaining_units_stored(v):
    """Units without a result, both stored by key: the join needs no shuffle."""
    name, at = uuid.uuid4().hex, shared_dir(v.spark)
    done = v.table("labels").where("quality <> 0").select("doc_id")
    wanted = state.stored_by_key(v.table("documents").select("doc_id", "source"), f"wanted_{name}", "doc_id", path=f"{at}/wanted-{name}", buckets=8)
    return state.remaining(wanted, state.stored_by_key(done, f"done_{name}", "doc_id", path=f"{at}/done-{name}", buckets=8), "doc_id")


@query
def benchmark_phrases(v):
    """Which documents hold the first words of a benchmark item."""
    phrases = v.table("benchmark").select(F.substring("text", 1, 30).alias("word"))
    return lookup.found_words(v.table("documents"), phrases)


@query
def best_titles(v):
    """Of the names of parts with their brand, the kinds and names of parts that match best."""
    part = v.table("part")
    names = part.select(F.concat_ws(" - ", "p_name", "p_brand").alias("name")).distinct().select(F.col("name").alias("candidate_id"), "name")
    entries = part.groupBy(F.concat_ws(" ", "p_type", "p_name").alias("title")).agg((F.max("p_size") > 48).alias("verified"),
        (F.min("p_size") - 2).cast("bigint").alias("subscribers"), (F.min("p_partkey") % 17).cast("int").alias("rank"))
    return lookup.best_titles(names, entries).drop("candidate_id")

"""Canonical views (comments, videos, posts, ...) over stored tables, each built when asked for.

The adapter maps the star schema of the test tables onto the model: a line item is a comment of a
customer on a part, an order is a thread whose first line is top-level, a part is a video, an
event is an outside post, a nation of suppliers is a channel.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """A stored table by its file ending: Parquet, ORC, JSON lines, CSV with a header."""
    for ending, kind in ((".parquet", "parquet"), (".orc", "orc"), (".json", "json"), (".csv", "csv")):
        if name.endswith(ending):
            return spark.read.options(**({"header": "true"} if kind == "csv" else {}), **options).format(kind).load(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Views:
    """The canonical views of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def all_comments(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("thread_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("video_id"),
            F.col("o_custkey").alias("actor_id"), F.col("l_suppkey").alias("supplier_id"),
            (F.col("l_linenumber") == 1).alias("is_top_level"), F.col("l_quantity").cast("bigint").alias("like_count"), F.col("l_shipdate").alias("ts"),
            F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "positive").otherwise("neutral").alias("label"),
            (F.col("l_discount") * 5).alias("score_neg"), (F.col("l_tax") * 5).alias("score_pos"),
            (1 - F.col("l_discount") * 5).alias("score_neu"), F.when(F.col("l_linenumber") != 5, F.col("l_linenumber") / 8).alias("confidence"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        """Top-level comments: what structure is measured on."""
        return self.all_comments.where("is_top_level")

    @cached_property
    def videos(self) -> DataFrame:
        seen = self.table("lineitem").groupBy(F.col("l_partkey").alias("video_id")).agg(F.min("l_shipdate").alias("published_at"))
        return self.table("part").select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"),
            F.col("p_type").alias("theme"), F.col("p_brand").alias("label"), F.floor(F.col("p_retailprice") * 10).alias("view_count")).join(seen, "video_id")

    @cached_property
    def actors(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("actor_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("community"))

    @cached_property
    def actor_videos(self) -> DataFrame:
        """Distinct (actor, video) of all comments."""
        return self.all_comments.select("actor_id", "video_id").distinct()

    @cached_property
    def posts(self) -> DataFrame:
        """Enriched posts: a fifth have labels, one in a hundred each is irrelevant or noise, three
        in a hundred are hints."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            "event_id", F.col("event_id").cast("string").alias("post_uid"), "ts", F.to_date("ts").alias("day"),
            F.col("event_type").alias("topic"), F.concat_ws(" ", "event_type", "event_id").alias("title"), F.col("value").alias("engagement"),
            F.when(F.col("user_id") % 2 == 0, "forum_a").otherwise("forum_b").alias("source"), F.col("user_id").alias("author"),
            (k >= 97).alias("hint"), (F.col("user_id") % 5 == 0).alias("semantic"), (k != 0).alias("relevant"), (k == 1).alias("noise"),
        )

    @cached_property
    def channels(self) -> DataFrame:
        """(supplier_id, channel): the channel of each supplier."""
        nations = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("channel"))
        return self.table("supplier").join(F.broadcast(nations), "s_nationkey").select(F.col("s_suppkey").alias("supplier_id"), "channel")

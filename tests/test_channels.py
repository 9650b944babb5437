"""Channel metrics of channels whose names and ids are odd."""

from pyspark.sql import functions as F

from tidemark.operators import channels
from tidemark.sources.views import Views

SETTINGS = channels.Settings(core=0.01, regular=0.004, least_shared_videos=1, least_video_actors=2, least_shared_actors=1)


def metrics(comments, v):
    communities, clusters = v.actors.select("actor_id", "community"), v.videos.select("video_id", F.col("label").alias("cluster"))
    return {(r.channel, r.metric): r.value for r in channels.channel_metrics(comments, v.videos, communities, clusters, SETTINGS).collect()}


def test_names_with_separators_and_null_ids(spark, small):
    v = Views(spark, small)
    pick = F.when(F.col("supplier_id") % 3 == 0, "A").when(F.col("supplier_id") % 3 == 1, "B").otherwise("C")
    comments = v.all_comments.withColumn("channel", pick)
    want = metrics(comments, v)
    assert {m for _, m in want} >= {"commenter_network_density", "video_network_density"}
    odd = {"A": "A|x", "B": "A|y", "C": ""}
    name = F.create_map(*(F.lit(x) for pair in odd.items() for x in pair))[F.col("channel")]
    lost = comments.limit(5).withColumns({"actor_id": F.lit(None).cast("bigint"), "video_id": F.lit(None).cast("bigint")})
    got = metrics(comments.unionByName(lost).withColumn("channel", name), v)
    networks = lambda found: {k: x for k, x in found.items() if "network" in k[1] or "community" in k[1]}
    assert networks(got) == networks({(odd[c], m): x for (c, m), x in want.items()})


def test_shares_of_replies_from_threads_made_once(spark, small):
    from tidemark.operators import threads

    comments = Views(spark, small).all_comments.withColumn("channel", F.col("supplier_id") % 3)
    names = ["channel", "reply_share", "replied_thread_share", "reply_negative_rate"]
    want = threads.reply_overview(comments, "channel").select(*names).collect()
    got = threads.reply_shares(threads.thread_metrics(comments, "channel", actors=False), "channel").select(*names).collect()
    assert want and sorted(got) == sorted(want)

"""Video clusters: what each holds, its themes against all, and the pairs of videos worth linking.

A cluster of videos is a partition (video_id, cluster) of the shared-audience graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import places
from tidemark.operators.graph import both, opportunity_type
from tidemark.operators.themes import affinity


def clustered_videos(partition: DataFrame, videos: DataFrame, comments: DataFrame) -> DataFrame:
    """(video_id, cluster, title, published_at, view_count, theme, n_comments, n_commenters)."""
    own = comments.join(partition.select("video_id"), "video_id", "left_semi")  # the others' commenters need no counting
    stats = own.groupBy("video_id").agg(F.count("*").alias("n_comments"), F.countDistinct("actor_id").alias("n_commenters"))
    return partition.join(videos.select("video_id", "title", "published_at", "view_count", "theme"), "video_id", "left").join(stats, "video_id", "left")


def _ranked_text(rows: DataFrame, by: str, label: str, order: list[str], value: str, k: int, cut: int) -> DataFrame:
    """(by, _text): the first k labels with their values in brackets, most first, ties by name. Rows beyond
    the k first of a group are left out before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc_nulls_last(c) for c in order), label))
    top = rows.where(F.coalesce(F.col(label), F.lit("")) != "").withColumn("_place", place).where(F.col("_place") <= k)
    text = F.concat(F.substring(F.col(label), 1, cut), F.lit(" ("), F.col(value).cast("string"), F.lit(")"))
    items = F.array_sort(F.collect_list(F.struct("_place", text.alias("t"))))
    return top.groupBy(by).agg(F.array_join(items["t"], "; ").alias("_text"))


def cluster_summary(clustered: DataFrame, comments: DataFrame, labels: DataFrame, *, k: int = 5) -> DataFrame:
    """Per cluster: videos, dates, comments, distinct commenters, median commenters of a video, views, and the
    commonest labels and most commented videos. labels: (video_id, label)."""
    own = clustered.groupBy("cluster").agg(
        F.count("*").alias("n_videos"), F.min("published_at").alias("date_min"), F.max("published_at").alias("date_max"),
        F.coalesce(F.sum("n_comments"), F.lit(0)).alias("n_comments"),
        places(F.median("n_commenters")).alias("median_commenters"), F.coalesce(F.sum("view_count"), F.lit(0)).alias("total_views"),
    )
    actors = comments.join(clustered.select("video_id", "cluster"), "video_id").select("cluster",
        "actor_id").distinct().groupBy("cluster").agg(F.count("actor_id").alias("n_commenters"))
    counts = labels.join(clustered.select("video_id", "cluster"), "video_id").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    top_labels = _ranked_text(counts, "cluster", "label", ["n"], "n", k, 10_000).withColumnRenamed("_text", "top_labels")
    top_videos = _ranked_text(clustered, "cluster", "title", ["n_commenters", "n_comments"], "n_commenters", k, 48).withColumnRenamed("_text", "top_videos")
    return own.join(actors, "cluster", "left").join(top_labels, "cluster", "left").join(top_videos, "cluster", "left")


def cluster_affinity(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    """The affinity of clusters for labels over their videos, with labels or without."""
    units = clustered.select("cluster", F.col("video_id").alias("_pair"))
    pairs = units.join(labels.select(F.col("video_id").alias("_pair"), "label"), "_pair")
    names = {"pairs": "n_videos", "group_pairs": "cluster_videos", "label_pairs": "label_videos", "share": "cluster_share"}
    return affinity(pairs, "cluster", "label", units).withColumnsRenamed(names)


def described_opportunities(found: DataFrame, edges: DataFrame, clustered: DataFrame, actor_videos: DataFrame) -> DataFrame:
    """The top pairs (a, b, ...) of link_opportunities with titles, themes, clusters, the audience that they share
    now, the kind of the opportunity, and their common neighbours (ten ids, and the titles of the five with
    most commenters)."""
    side = lambda x: clustered.select(F.col("video_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("title", "theme", "cluster")))
    pairs = found.select("a", "b")
    seen = lambda x: actor_videos.select(F.col("video_id").alias(x), "actor_id")
    shared = pairs.join(seen("a"), "a").join(seen("b"), ["b", "actor_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    ends = both(edges).select("u", "v")
    mids = pairs.join(ends.select(F.col("u").alias("a"), F.col("v").alias("mid")),
        "a").join(ends.select(F.col("u").alias("b"), F.col("v").alias("mid")), ["b", "mid"])
    mids = mids.join(clustered.select(F.col("video_id").alias("mid"), F.coalesce("n_commenters", F.lit(0)).alias("_n"),
        F.coalesce("title", F.col("video_id").cast("string")).alias("_title")), "mid")
    by_id = F.row_number().over(Window.partitionBy("a", "b").orderBy("mid"))
    by_size = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("_n"), F.desc("_title"), F.desc("mid")))
    mids = mids.withColumns({"_i": by_id, "_j": by_size}).where("_i <= 10 or _j <= 5")
    ids = F.array_sort(F.collect_list(F.when(F.col("_i") <= 10, F.struct("_i", F.col("mid").cast("string").alias("t")))))
    titles = F.array_sort(F.collect_list(F.when(F.col("_j") <= 5, F.struct("_j", F.substring("_title", 1, 72).alias("t")))))
    common = mids.groupBy("a", "b").agg(F.array_join(ids["t"], "; ").alias("common_ids"), F.array_join(titles["t"], "; ").alias("common_titles"))
    out = found.join(side("a"), "a").join(side("b"), "b").join(shared, ["a", "b"], "left").join(common, ["a", "b"], "left")
    out = out.withColumns({"shared": F.coalesce("shared", F.lit(0)), "same_theme": F.coalesce("a_theme", F.lit("")) == F.coalesce("b_theme",
        F.lit("")), "same_cluster": F.col("a_cluster").eqNullSafe(F.col("b_cluster"))})
    return out.withColumn("kind", opportunity_type()).drop("same_theme", "same_cluster")

"""Fuzzy matching of names to search results, and keyword variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio0


def plain_name(c: Column) -> Column:
    """Lower case, letters and digits of any script, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def match_score(expected: Column, found: Column, verified: Column, subscribers: Column, rank: Column) -> Column:
    """100 for equal names, 45 for one within the other, 40 by shared words, 15 if verified, 5 if
    subscribers are known, less the rank."""
    a, b = plain_name(expected), plain_name(found)
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    share = ratio0(F.size(F.array_intersect(words(a), words(b))), F.size(words(a)))
    inside = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    return F.when((a == b) & (a != ""), 100).otherwise(0) + F.when(inside, 45).otherwise(0) + 40 * share + F.when(verified,
        15).otherwise(0) + F.when(subscribers > 0, 5).otherwise(0) - rank


def best_matches(entries: DataFrame, *, key: str = "candidate_id", least: float = 45.0) -> DataFrame:
    """The best entry of each candidate with its score and confidence; ties go to the lower rank."""
    score = match_score(F.col("name"), F.col("title"), F.coalesce("verified", F.lit(False)), F.coalesce("subscribers", F.lit(0)), F.col("rank"))
    out = entries.withColumn("score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "rank", "title"))
    out = out.withColumn("_place", place).where("_place = 1").drop("_place")
    return out.withColumn("confidence", F.when(F.col("score") >= 100, "high").when(F.col("score") >= least, "medium").otherwise("low"))


def keyword_variants(c: Column, *, least: int = 2) -> Column:
    """The parts of a name at punctuation, and its parts of one script; first of equals, in order."""
    parts = F.split(c, r"[\s|/,;:()\[\]、，。\-]+")
    han = F.regexp_extract_all(c, F.lit(r"(\p{IsHan}+)"), F.lit(1))
    latin = F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    every = F.transform(F.concat(F.array(F.trim(c)), parts, han, latin), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(every, lambda x: F.length(x) >= least))

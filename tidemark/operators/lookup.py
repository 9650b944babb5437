"""Lists of words found in texts, and names matched to titles, for lists and catalogues of any length.

Neither lists words in an expression nor pairs everything with everything: what can match meets by a join on a
piece that both must share, the rarest there is, and is then checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.matching import match_score, plain_name
from tidemark.plans.tables import removed, written

#: Characters of the pieces by which words and texts meet; shorter words are pieces themselves.
PIECE = 3


def _pieces(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text."""
    # one pass: substring would count from the start each time, and a lambda's outer expressions are made anew
    run = lambda cs: F.transform(cs, lambda x, i: F.concat(x, *(F.get(cs, i + k) for k in range(1, size)))) if size > 1 else cs
    runs = F.get(F.transform(F.array(F.split(text, "")), run), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda x: x.isNotNull() & (F.char_length(x) == size)))


def found_words(texts: DataFrame, words: DataFrame, *, key: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """(key, word): the words that each text contains as they are written, each pair once.

    A word of at least PIECE characters meets texts by the one of its pieces that fewest texts hold (ties: the first
    in order), a shorter one by itself; what meets is checked. Null and empty words are in no text.
    """
    listed = words.where(F.char_length(word) > 0).select(F.col(word).alias("word")).distinct()
    held = F.col("word")
    own = F.when(F.char_length(held) >= PIECE, _pieces(held, PIECE)).otherwise(F.array(held))
    listed = written(listed.select("word", F.explode(own).alias("piece")), "pieces")
    # only texts' pieces that some word has are shuffled
    wanted = listed.select("piece").distinct()
    sizes = sorted(r[0] for r in wanted.select(F.char_length("piece")).distinct().collect()) or [PIECE]  # PIECE numbers at most
    every = F.concat(*(_pieces(F.col("_text"), n) for n in sizes))
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    marks = rows.select("_key", "_text").withColumn("_id", F.monotonically_increasing_id())
    cores = texts.sparkSession.sparkContext.defaultParallelism
    marks = written(marks.repartition(cores) if marks.rdd.getNumPartitions() < cores else marks, "texts")  # few splits are spread
    held_pieces = written(marks.select("_id", F.explode(every).alias("piece")).join(wanted, "piece", "left_semi"), "held")
    counts = held_pieces.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = listed.join(counts, "piece", "left").groupBy("word").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    pairs = held_pieces.join(rarest, "piece").select("_id", "word")
    lists = pairs.groupBy("_id").agg(F.collect_list("word").alias("_words"))  # a text's words are no more than it has places
    out = marks.join(lists, "_id").select(F.col("_key").alias(key), F.explode(F.filter("_words", lambda w: F.contains(F.col("_text"), w))).alias("word"))
    out = written(out, "found")
    for table in (listed, marks, held_pieces):
        removed(table)
    return out


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))


def best_titles(names: DataFrame, entries: DataFrame, *, key: str = "candidate_id", title: str = "title") -> DataFrame:
    """(key, name, title, rank, score): for each name the entry of the highest `match_score`, of equals that of the
    lowest rank, then title: what comparing all pairs would choose.

    entries: (title, verified, subscribers, rank). Names and titles within one another come from `found_words`. Words
    are looked up from the rarest on: an entry that shares none of a name's j rarest of n words scores at
    most 40 (n - j) / n beside what does not depend on the name, so a name whose best is above that is done,
    and its common words are never joined. The entry that is best by itself stands for all that share nothing.
    """
    base = F.when(F.coalesce("verified", F.lit(False)), 15).otherwise(0) + F.when(F.coalesce("subscribers", F.lit(0)) > 0, 5).otherwise(0) - F.col("rank")
    stored = entries.select(F.col(title).alias("title"), "verified", "subscribers", "rank", plain_name(F.col(title)).alias("_b"), base.alias("_base"))
    stored = written(stored.withColumn("_e", F.monotonically_increasing_id()), "entries")
    asked = names.select(F.col(key).alias("_key"), "name", plain_name(F.col("name")).alias("_a")).withColumn("_n", F.monotonically_increasing_id())
    asked = written(asked, "names")
    most = stored.agg(F.max("_base")).first()[0]
    if most is None:
        return asked.select(F.col("_key").alias(key), "name", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("rank"),
            F.lit(None).cast("double").alias("score")).limit(0)
    inverted = written(stored.select("_e", F.explode(_words(F.col("_b"))).alias("token")), "tokens")
    counts = inverted.groupBy("token").agg(F.count("*").alias("n"))
    own = asked.select("_n", F.explode(_words(F.col("_a"))).alias("token")).join(counts, "token", "left")
    place = F.row_number().over(Window.partitionBy("_n").orderBy(F.coalesce("n", F.lit(0)), "token"))
    own = written(own.select("_n", "token", place.alias("place"), F.count("*").over(Window.partitionBy("_n")).alias("size")), "words")
    titles, asked_names = stored.where("_b <> ''"), asked.where("_a <> ''")
    inside = found_words(titles, asked_names, key="_e", text="_b", word="_a").withColumnRenamed("word", "_a").join(asked.select("_n", "_a"), "_a").select("_n", "_e")
    around = found_words(asked_names, titles, key="_n", text="_a", word="_b").withColumnRenamed("word", "_b").join(stored.select("_e", "_b"), "_b").select("_n", "_e")
    alone = stored.orderBy(F.desc("_base"), "rank", "title").limit(1).select("_e")

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.distinct().join(stored, "_e").join(asked, "_n")
        score = match_score(F.col("name"), F.col("title"), F.coalesce("verified", F.lit(False)), F.coalesce("subscribers", F.lit(0)), F.col("rank"))
        top = F.min_by(F.struct("title", "rank", "score"), F.struct(-F.col("score"), "rank", "title"))
        return rows.withColumn("score", F.round(score, 6)).groupBy("_n").agg(top.alias("b")).select("_n", "b.*")

    def better(a: DataFrame, b: DataFrame) -> DataFrame:
        top = F.min_by(F.struct("title", "rank", "score"), F.struct(-F.col("score"), "rank", "title"))
        return a.unionByName(b).groupBy("_n").agg(top.alias("b")).select("_n", "b.*")

    first = asked.select("_n").crossJoin(alone)  # one row
    best = written(scored(inside.unionByName(around).unionByName(first)), "best")
    step, last = 0, own.agg(F.max("size")).first()[0] or 0
    while step < last:  # as many rounds as the longest name has words, at most
        bound = 40.0 * (F.col("size") - step) / F.col("size") + float(most)
        todo = own.where(F.col("place") == step + 1).join(best.select("_n", "score"), "_n").where(F.col("score") <= bound)
        fresh = written(todo.join(inverted, "token").select("_n", "_e"), "pairs")
        if fresh.head(1):
            best = written(better(best, scored(fresh)), "best", instead_of=best)
        removed(fresh)
        step += 1
    out = written(asked.join(best, "_n").select(F.col("_key").alias(key), "name", "title", "rank", "score"), "titles")
    for table in (stored, asked, inverted, own, best):
        removed(table)
    return out

"""Words in texts and names among titles, against all pairs."""

import random

from pyspark.sql import functions as F

from tidemark.functions.matching import best_matches
from tidemark.operators import lookup


def test_words_in_texts(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abc 台灣é") for _ in range(n))
    texts = [(i, some(rng.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "ab"), (202, "abc"), (None, "台灣")]
    words = sorted({some(rng.randint(1, 6)) for _ in range(150)}) + ["a", "ab", "台灣", "zzzz"]
    got = lookup.found_words(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(w,) for w in [*words, words[0], None, ""]], "word string"))
    want = sorted([(i, w) for i, t in texts for w in set(words) if t and w and w in t], key=repr)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want and len(want) > 300


def test_a_hundred_thousand_words(spark):
    """A list far longer than an expression could hold; the rows that meet are few."""
    words = spark.range(100_000).select(F.concat(F.lit("alias "), F.md5(F.col("id").cast("string"))).alias("word"))
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("some alias "), F.md5((F.col("id") * 700).cast("string")), F.lit(" more text")).alias("text"))
    got = lookup.found_words(texts, words)
    assert got.count() == sum(i * 700 < 100_000 for i in range(200))


def test_best_titles_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    words = ["the", "the", "the", "show", "show", "food", "trip", "ian", "eric", "台灣", "lab"]
    name = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    names = [(i, name(4)) for i in range(60)] + [(100, ""), (101, None), (102, "unseen"), (103, "foodtripian")]
    entries = sorted({name(3) for _ in range(60)} | {"foodtrip", "", "the showroom"})
    entries = [(t, rng.random() < 0.3, rng.choice([0, 5, None]), rng.randrange(12)) for t in entries]
    asked, stored = spark.createDataFrame(names, "candidate_id long, name string"), spark.createDataFrame(entries, "title string, verified boolean, subscribers long, rank int")
    want = {(r.candidate_id, r.title, r["rank"], r.score) for r in best_matches(asked.crossJoin(stored)).collect()}
    got = lookup.best_titles(asked, stored)
    assert {(r.candidate_id, r.title, r["rank"], r.score) for r in got.collect()} == want and len(want) == 64
    assert lookup.best_titles(asked, stored.limit(0)).count() == 0 and lookup.best_titles(asked.limit(0), stored).count() == 0

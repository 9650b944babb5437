import collections
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))

import corpus_pipeline
from tidemark.llm import queries
from oracle_check import rows_of_query, rows_of_sql


def test_stages_keep_columns_and_act(spark, small, hard):
    docs = hard
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, small).cache()
        assert out.columns == docs.columns and 0 < out.count() <= before, name
        docs, before = out, out.count()
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids))
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, small)
    assert mixed.columns == docs.columns and set(r.doc_id for r in mixed.collect()) <= set(ids)


def test_stages_take_empty_tables(spark, small, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0, name


def test_pipeline_runs(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(r.n_tokens >= 0 for r in rows)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.ids_sha256)
    assert all(len(v) == 1 for v in by.values())


def test_queries_match_sql(spark, small):
    for name, sql in queries.ORACLE.items():
        assert rows_of_query(queries.QUERIES[name](spark, small)) == rows_of_sql(sql, small)


def test_reruns_agree(spark, small):
    first = rows_of_query(queries.QUERIES["op1_entropy_mix"](spark, small))
    assert first == rows_of_query(queries.QUERIES["op1_entropy_mix"](spark, small))


def test_near_duplicates_are_those_of_simhash_and_of_near_copies(spark, small):
    """No two kept documents are in one component of SimHash, and each component of both relations keeps its smallest id."""
    from pyspark.sql import functions as F
    from tidemark.llm import neardup

    words = [f"w{i}" for i in range(5000)]
    long = lambda a, n: " ".join(words[a : a + n])
    # 2 is a near copy of 1; 4 and 5 are equal; 6 and 7 have no words
    texts = {1: long(0, 200), 2: long(0, 190), 3: long(1000, 200), 4: "a b", 5: "a b", 6: None, 7: "", 8: long(2000, 3000), 9: long(2000, 2990) + " x y z"}
    # texts whose fingerprints link and whose sets of five words do not
    texts |= {10: "the same three words " * 40, 11: "same three words the " * 40 + "same three words"}
    texts |= {20 + i: "one two three " * 50 + f"end{i}" for i in range(6)}
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    prints = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    copies = {r.doc_id: r.component_id for r in neardup.near_copies(docs).collect()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for part in (prints, copies):
        for k, c in part.items():
            x, y = sorted((find(k), find(c)))
            root[y] = x
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).select(F.col("doc_id")).collect()]
    assert sorted(kept) == sorted({find(k) for k in texts})
    assert any(prints[k] != k and copies[k] == k for k in texts), "SimHash links more than near copies do"

"""The contracts of the opN queries on the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import pytest

from tidemark.llm import queries

COLUMNS = {
    "op1_entropy_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_mpeg_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string",
    "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_toxicity_ftrl": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_quality_gbt": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_hilbert_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint",
    "grown_shard": "int"},
    "op8_warc_index": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op9_simhash_golay": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_decision_list": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
    "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint",
    "runs_sha256": "string", "collapsed_sha256": "string"},
    "op12_pstable_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op13_centroids": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint",
    "centroid_sha256": "string"},
}
TABLES = {"op8": ("pages", "page_id"), "op12": ("embeddings", "vec_id"), "op13": ("embeddings", "vec_id")}
FOLDS = {"op4_language_id": (4, 2), "op5_toxicity_ftrl": (3, 1), "op6_quality_gbt": (3, 1)}
LEAST = {"op5_toxicity_ftrl": 0.7, "op6_quality_gbt": 0.5}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, small, name):
    out = queries.QUERIES[name](spark, small).cache()
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    table, key = TABLES.get(name.split("_")[0], ("documents", "doc_id"))
    rows = out.collect()
    want = [r[0] for r in duckdb.sql(f"SELECT {key} FROM '{small}/{table}.parquet'").fetchall()]
    assert sorted(r[key] for r in rows) == sorted(want)
    if name in FOLDS:
        n, held = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held) and 0 <= r.score <= 1 for r in rows)
    if name in LEAST:
        assert all(r.predicted == (r.score >= LEAST[name]) for r in rows)
    out.unpersist()


def test_held_out_rows(spark, small):
    """Held-out documents of a larger table are told apart."""
    folder = Path(small).parent / "sf0.01"
    if not folder.is_dir():
        pytest.skip("no test tables")
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    rows = [r for r in queries.QUERIES["op4_language_id"](spark, str(folder)).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    rows = [r for r in queries.QUERIES["op6_quality_gbt"](spark, str(folder)).collect() if r.held_out and r.doc_id in marks]
    assert sum(marks[r.doc_id] == r.predicted for r in rows) >= 0.95 * len(rows) > 0

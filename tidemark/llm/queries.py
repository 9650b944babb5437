"""The thin queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, centroids, hilbert, langid, mixing, mpeg, neardup, quality, rules, runs, toxicity, vectordup, warc
from tidemark.llm.common import fold, table, written


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that an entropy-balanced mix of their sources takes."""
    mix = mixing.document_copies(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    return bpe_digests(bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an MPEG audio stream and read back."""
    stored = written(mpeg.store_texts(table(spark, sf_dir, "documents")), "media")
    return mpeg.media_features(stored)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from three quarters of the ids."""
    docs = table(spark, sf_dir, "documents")
    known = docs.where(fold(4) != 2).select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(known))
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels of two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    return verdicts(toxicity.score(docs, model), 0.7)


def op6_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labels of two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    return verdicts(quality.score(docs, model), 0.5)


def verdicts(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along the Hilbert curve, of counts at most one apart."""
    out = hilbert.shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back through their index."""
    return warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False).drop("url")


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their SimHash and the component of near duplicates that they are in."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with base statistics and the verdict of a decision list learnt from labels."""
    out, _ = rules.filtered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their runs of repeated words, after the tails that ids choose are made periodic."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return runs.run_digests(runs.find_runs(table(spark, sf_dir, "documents"), prepare=runs.repeat_tails, more={"_crc": crc}))


def op12_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links at cosine 0.98 within their label, and their components."""
    return vectordup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors in eight clusters after ten rounds, in exact integers."""
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_mix": op1_entropy_mix,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_mpeg_media": op3_mpeg_media,
    "op4_language_id": op4_language_id,
    "op5_toxicity_ftrl": op5_toxicity_ftrl,
    "op6_quality_gbt": op6_quality_gbt,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_warc_index": op8_warc_index,
    "op9_simhash_golay": op9_simhash_golay,
    "op10_decision_list": op10_decision_list,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pstable_vectors": op12_pstable_vectors,
    "op13_centroids": op13_centroids,
}

def _centroids_sql(rounds: int = 10) -> str:
    """Rounds one after another; all sums are small integers, so doubles hold them exactly."""
    near = lambda c: f"""SELECT key, v, d.c AS cluster, d.d AS distance FROM (SELECT k.key, k.v, min({{'d':
        list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, m.v) + list_inner_product(m.v, m.v), 'c': m.c}}) AS d FROM kept k, {c} m GROUP BY ALL)"""  # noqa: E731
    parts = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept ORDER BY c LIMIT 8)"""]
    for r in range(rounds):
        parts += [f"a{r} AS MATERIALIZED ({near(f'c{r}')})",
            f"""s{r} AS (SELECT cluster, i, floor(sum(v[i]) / count(*)) AS x FROM (SELECT cluster, v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY ALL)""",
            f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c
            LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM s{r} GROUP BY cluster) n ON n.cluster = c.c)"""]
    return "WITH " + ",\n".join(parts) + f""", a AS ({near(f"c{rounds}")})
        SELECT k.vec_id, a.cluster::INT AS cluster, a.distance::BIGINT AS distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
               (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM a JOIN kept k USING (key) JOIN c{rounds} c ON c.c = a.cluster"""


ORACLE: dict[str, str] = {
    "op12_pstable_vectors": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS key, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        w AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0),
        pairs AS MATERIALIZED (SELECT a.key AS a, b.key AS b FROM w a JOIN w b ON a.label = b.label AND a.key <> b.key AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT key AS a, key AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
        least AS (SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.key = r.b GROUP BY r.a),
        links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
        SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, component_id IS NOT DISTINCT FROM v.vec_id AS kept
        FROM v JOIN least l ON l.a = v.key LEFT JOIN links k ON k.a = v.key
    """,
    "op13_centroids": _centroids_sql(),
    "op8_warc_index": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM r
    """,
}

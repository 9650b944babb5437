"""From raw documents to token ids: five stages, each a written table's worth of work.

Documents whose language cannot be told, low-quality documents, and near copies go; the sources
are mixed to their target weights (documents may repeat); what is left is encoded.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables (which give
empty ones) and further columns of any name; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, neardup, quality
from tidemark.llm.common import table, written
from tidemark.llm.queries import bpe_digests, tokenizer_path

#: Part of a text's letter n-grams that its language must know.
LEAST_KNOWN = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language, whole. Null and empty texts and texts without a letter have none and
    go; so do all documents if none has a text and a lang to learn from. Repeated rows are judged alike."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.accepted(docs, model, least=LEAST_KNOWN)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores 0.5 or more; without labels of both kinds the share of
    label 1 is everyone's score (0.5 without any). Null and empty texts are scored like any others; repeated rows
    are scored alike."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of SimHash links (three-word shingles, at most 3 differing bits) and of
    near copies (five-word shingles, similarity 0.8 or more) together, that of the smallest id, a null id last; of
    rows that share an id the text's hash decides. Null and empty texts are one component."""
    return neardup.deduplicated_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null and empty texts take no words and stay once; a null
    source is one of its own, the last; ties go by the id, then the text's hash."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' digests of every document of the mix; null and empty texts have no ids. Keys may repeat."""
    return bpe_digests(bpe.encode_documents(docs, tokenizer_path()))


STAGES = [
    ("language identification", identify_language),
    ("quality classifier", classify_quality),
    ("SimHash near-duplicates", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: Models, fingerprints and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids: each stage's result is written as Parquet and read by the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and further columns, and an empty table gives an empty one; what it does with
them is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemo.llm import mixing, pieces, pii, quality, shingles
from mnemo.llm.common import table
from mnemo.sources.durable import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines. Null and empty texts have too few words and go; equal rows share their fate."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word shingle similarity of 0.8 or more one stays, the one with the smallest doc_id.

    Texts without words are alike, so one of them stays; a null doc_id is the
    smallest of none; of equal rows one stays.
    """
    return shingles.one_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; every document stays, a null text as null."""
    return pii.replace_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources to target weights, repeats included, in shard order. Null sources are one source; texts without words are in no draw."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, with the count that says whether decoding gives the text back. A null or empty text has no pieces."""
    return pieces.encoded(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("pii_surrogates", surrogates),
    ("mix_sources", mix_sources),
    ("sentencepiece", token_ids),
]

#: Hashes place documents in blocks and shards and pick surrogates, which SQL of another engine can't follow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = durable(docs) if i < len(STAGES) - 1 else docs
    return docs

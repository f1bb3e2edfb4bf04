"""A corpus pipeline of the text operators: identify, deduplicate, sanitise, mix, encode.

Each stage works on all rows that its predecessor kept; its result is written as Parquet in the shared checkpoint
folder and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from preyscope.llm import langid, mixing, near_copies, pii, sentencepiece_codec
from preyscope.llm.common import documents, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language."""
    return langid.keep_identified(docs, langid.train(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles of similarity 0.8 or more, found by SimHash
    covering tables and, beyond their radius, bands of minima, and all verified."""
    return near_copies.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and drops documents so that sources have their target sizes."""
    return mixing.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row of the mix."""
    import public_tokenizers

    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("simhash_near_dedup", deduplicate),
    ("pii", sanitise),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: Predictions of a trained model and token ids can't be expressed in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs

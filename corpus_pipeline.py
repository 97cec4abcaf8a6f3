"""A corpus from raw documents to token ids: STAGES, each over all that the one before it kept.

Each stage is written as Parquet to the shared folder and read again, so that a
lost executor costs no more than the stage at work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyanchor.llm import bpe, minhash, mixing, quality, toxicity
from skyanchor.llm.textkit import shared_dir


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject, with all their columns.

    Null and empty texts are rejected, very long ones are judged whole; a score
    exactly at the threshold stays; equal rows fare alike; other columns, whatever
    their names, come through; an empty table gives one.
    """
    return quality.keep_good(docs, _labels(spark, sf_dir), column=None)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier doesn't reject, with all their columns.

    Null, empty and wordless texts stay, very long ones are judged whole; a score
    exactly at the threshold goes; equal rows fare alike; other columns, whatever
    their names, come through; an empty table gives one.
    """
    return toxicity.keep_clean(docs, _labels(spark, sf_dir), column=None)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with all its columns, of each group of exact and near copies: that of the least doc_id, nulls last.

    Null texts stay, each of them; empty ones are copies of each other; very long ones
    are compared whole; a pair exactly at the threshold is one of copies, of equal
    doc_ids the least MD5 of the text stays, of equal rows one; other columns, whatever
    their names, come through; an empty table gives one.
    """
    return minhash.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with all their columns, as often as equal shares of the sources ask.

    Null is a source of its own; null and empty texts have no tokens but are repeated
    as their source, very long ones are counted whole; a source without any tokens
    goes; a draw equal to the fraction gives no copy; equal rows fare alike; other
    columns, whatever their names, come through; an empty table gives one.
    """
    return mixing.mix_sources(docs, ordinal=None)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number in place of texts, with the other columns but those of the names ids and n_tokens.

    A null text has null ids, an empty one none, a very long one is coded whole; of
    equal merges the leftmost goes first; equal rows are each coded; an empty table gives one.
    """
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", tokens_stage),
]

#: The classifiers, sketches and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each but the last goes through Parquet in the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The operators as queries over their whole tables, with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, jpeg, minhash, mixing, quality, rans, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with whether the default blocklist blocks its URL, and by which rule."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.default_blocklist(spark))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents at equal shares of tokens for all sources."""
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    return bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), decode=True)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, with their scores."""
    docs = _read(spark, sf_dir, "documents")
    return quality.keep_good(docs, _read(spark, sf_dir, "labels")).select("doc_id", "quality_score")


def op5_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids as coded blocks, and the shared table."""
    return rans.encode_documents(_read(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with the copies of each that go."""
    return minhash.deduplicated(_read(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bottom-k sketch of every document, compared with that of its source; its class of equal sketches and the number of documents that share its hashes."""
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier keeps, with their scores."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.keep_clean(docs, _read(spark, sf_dir, "labels")).select("doc_id", "toxicity_score")


def op9_media_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB tensors of the progressive JPEG drawn from each row of embeddings."""
    return jpeg.decode_media(jpeg.rendered(_read(spark, sf_dir, "embeddings")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one formatted text with the byte spans of its answers as 'start-stop,…'."""
    done = chat.format_chats(_read(spark, sf_dir, "conversations"))
    span = F.transform("answers", lambda a: F.concat_ws("-", a["start"].cast("string"), a["stop"].cast("string")))
    return done.withColumn("answers", F.array_join(span, ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_mix_sources, op3_byte_bpe, op4_quality_classifier, op5_rans_tokens,
        op6_minhash_dedup, op7_fingerprints, op8_toxicity, op9_media_tensors, op10_chat_format,
    )
}

ORACLE_SQL = {"op1_url_filter": urls.SQL, "op2_mix_sources": mixing.sql(), "op10_chat_format": chat.SQL}

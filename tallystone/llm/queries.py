"""Queries of this subpackage: name -> function of (spark, sf_dir); SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dart_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from tallystone.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tallystone.llm.htmltext import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored in and read back from an ISO media container."""
    from tallystone.llm.media import store_texts

    return store_texts(_table(spark, sf_dir, "documents"))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the self-attention model."""
    from tallystone.llm.lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op5_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document."""
    from tallystone.llm.licences import licences

    return licences(_table(spark, sf_dir, "documents"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    from tallystone.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture of sources takes each document."""
    from tallystone.llm.mixing import mixed

    return mixed(_table(spark, sf_dir, "documents"))


def op8_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the byte-level convolutional network."""
    from tallystone.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text under the multilingual public vocabulary, and their decoding."""
    from tallystone.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of each query vector."""
    from tallystone.llm.topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_dart_near_dedup, op2_html_main_text, op3_media_columns, op4_attention_lm, op5_licence_notices, op6_warc_archives, op7_mixture, op8_byte_cnn_quality, op9_prefix_bpe, op10_exact_top_k)}


def oracle_sql() -> dict[str, str]:
    from tallystone.llm.mixing import mixing_sql
    from tallystone.llm.topk import TOP_K_SQL
    from tallystone.llm.warc import ARCHIVE_SQL

    return {"op6_warc_archives": ARCHIVE_SQL, "op7_mixture": mixing_sql(), "op10_exact_top_k": TOP_K_SQL}

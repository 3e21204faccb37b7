"""A corpus through four stages: quality, near-duplicates, mixture of sources, byte-level BPE.

Each stage works on all documents that its predecessor kept. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm.bpe import encode_documents
from tallystone.llm.mixing import Targets, keep_mixed
from tallystone.llm.neardup import keep_representatives
from tallystone.llm.quality import keep_good
from tallystone.llm.scratch import Scratch

#: One epoch at most: a document of the result occurs once.
TARGETS = Targets(max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labels of documents at hand.

    Null texts are judged as empty ones, repeated rows alike; without labels of both kinds all get their share, which
    is below the threshold unless nearly all labels are good. An empty table gives an empty table.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of least id, with all rows of that id.

    Null texts count as empty, and all empty texts are one class; rows without an id are kept.
    """
    return keep_representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budgets of their sources, each at most once.

    Null texts have no tokens and cost nothing; null names of sources and languages count as the name "". Rows of one
    id stand or fall together within a source.
    """
    return keep_mixed(docs, TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each text, and digest of the decoded bytes; a row for each row, null texts as
    empty ones. An empty table gives an empty table."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixture", mixture), ("tokens", tokens)]

#: A trained network and a vocabulary decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

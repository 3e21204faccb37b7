"""Orders, quotas and assignments."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators.numbering import numbered

PRIORITIES = ("critical", "high", "medium", "low")
# Claim types that a summary shows first, and second.
FIRST_CLAIMS = ("official_warning",)
RISK_CLAIMS = ("identity_mismatch", "counterfeit_product_allegation", "account_page_disappearance")


def priority_rank(priority: Column) -> Column:
    out = F.lit(len(PRIORITIES) - 1)
    for i, name in enumerate(PRIORITIES[:-1]):
        out = F.when(priority == name, i).otherwise(out)
    return out


def highlights(evidence: DataFrame) -> DataFrame:
    """The one positive row of each entity to show first."""
    order = [
        (F.col("author_type") == "customer").desc(),
        F.col("verified").desc(),
        F.col("band").isin("strong", "very_strong").desc(),
        F.col("transaction_evidence").desc(),
        F.col("confidence").desc(),
        F.coalesce("published_at", "captured_at").desc(),
        F.col("evidence_id").asc(),
    ]
    rows = evidence.where("duplicate_of is null and sentiment = 'positive'")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("merchant_id").orderBy(*order))).where("_r = 1").drop("_r")


def important_claims(claims: DataFrame, most: int = 6) -> DataFrame:
    tier = F.when(F.col("claim_type").isin(*FIRST_CLAIMS), 0).when(F.col("claim_type").isin(*RISK_CLAIMS), 1).otherwise(2)
    w = Window.partitionBy("merchant_id").orderBy(tier, F.col("latest").desc(), F.col("independent").desc(), "claim_type")
    return claims.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def limited(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows; -1 means all."""
    return rows if most < 0 else rows.limit(most)


def balanced(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows in turns of the groups."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt to n agents in turns, in order of a key without repeats."""
    return numbered(rows, "agent", key).withColumn("agent", F.pmod(F.col("agent") - 1, F.lit(n)).cast("int"))


def chunked(rows: DataFrame, key: str, size: int) -> DataFrame:
    return numbered(rows, "chunk", key).withColumn("chunk", F.floor((F.col("chunk") - 1) / F.lit(size)).cast("int"))


def packed(rows: DataFrame, key: str, size: str, bins: int) -> DataFrame:
    """(key, size, bin): longest first, each to the emptiest bin so far, ties to the first.

    Which bin a row gets depends on all before it, so one task deals them, in order, with the bins' loads as its
    only state; rows pass through it in batches and aren't held.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap = [(0, b) for b in range(bins)]
        for pdf in batches:
            places = []
            for n in pdf[size]:
                load, b = heap[0]
                places.append(b)
                heapq.heapreplace(heap, (load + int(n), b))
            yield pdf.assign(bin=places)

    kept = rows.select(F.col(key).cast("long").alias(key), F.col(size).cast("long").alias(size))
    return kept.repartition(1).sortWithinPartitions(F.col(size).desc(), key).mapInPandas(pack, f"{key} long, {size} long, bin int")

"""Changes to keyed tables as whole-table expressions: the result is the table after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: list[str], *order: str | object) -> DataFrame:
    """The first row of each key in the given order (Columns or names, highest priority first)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(held: DataFrame, incoming: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Insert or overwrite; of several rows of a key the one of the highest sequence stands."""
    return last_per_key(held.unionByName(incoming), keys, F.col(sequence).desc())


def keep_best(rows: DataFrame, keys: list[str], score: str, sequence: str, values: list[str]) -> DataFrame:
    """Insert, or overwrite if the score is higher; an equal score leaves the row that came first."""
    best = F.max(F.struct(F.col(score), (-F.col(sequence)).alias("_s"), *[F.col(x).alias(f"_v_{x}") for x in values]))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{score}").alias(score), *[F.col(f"_b._v_{x}").alias(x) for x in values])


def insert_or_ignore(held: DataFrame, incoming: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Insert rows of unknown keys; the first writer of a key wins."""
    fresh = incoming.join(held.select(*keys), keys, "left_anti")
    return held.unionByName(last_per_key(fresh, keys, F.col(sequence).asc()))


def fill_only(held: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fill blank columns from incoming rows; values that are there stay, and unknown keys are added."""
    new = incoming.select(*keys, *[F.col(x).alias(f"_n_{x}") for x in columns])
    blank = lambda x: F.nullif(F.col(x), F.lit(""))
    return held.join(new, keys, "full").select(*keys, *[F.coalesce(blank(x), F.col(f"_n_{x}")).alias(x) for x in columns])


def migrated(rows: DataFrame, version: int) -> DataFrame:
    """Rows of schema ``version`` brought to version 5: a column for the canonical row, filled in; newer is refused."""
    if version > 5:
        raise ValueError("the table is newer than this reader")
    own = F.col("evidence_id")
    return rows.select(own, F.coalesce("duplicate_of", own).alias("canonical_id"), F.lit(5).alias("schema_version"))


def rewritten_keys(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace keys by ``mapping`` (old, new); keys that it doesn't have stay."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")

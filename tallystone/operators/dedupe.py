"""Duplicate observations: keepers, connected components of two fingerprints, roots, and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators.components import connected, shared_key_links
from tallystone.sources.exports import cut


def keepers_by_url(evidence: DataFrame) -> DataFrame:
    """Within an entity and link, the best row keeps its independence; the others point to it. Blank links keep."""
    best = [F.col("independent").desc(), F.col("confidence").desc(), F.col("captured_at").asc(), F.col("evidence_id").asc()]
    w = Window.partitionBy("merchant_id", "url").orderBy(*best)
    root = F.first("evidence_id").over(w)
    other = (F.trim("url") != "") & (root != F.col("evidence_id"))
    return evidence.withColumns({"root": F.when(other, root), "kept": F.when(other, 0).otherwise(F.col("independent"))})


def content_components(rows: DataFrame, group: str, keys: list[str], id_col: str) -> DataFrame:
    """``rows`` with ``component``: rows of one group that share a key, directly or through others, have the least
    id among them; a null key links nothing."""
    found = connected(shared_key_links(rows, group, keys, id_col)).withColumnRenamed("id", id_col)
    return rows.join(found, id_col, "left").withColumn("component", F.coalesce("component", id_col))


def rooted(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """The root of each component: a root already, else the earliest capture, else the least id. Others are no
    longer independent and point to it."""
    standing = F.when((F.col("independent") == 1) & F.col("duplicate_of").isNull(), 0).otherwise(1)
    root = F.first(id_col).over(Window.partitionBy(group, "component").orderBy(standing, F.col("captured_at").asc_nulls_last(), id_col))
    own = F.col(id_col) == root
    return rows.withColumns({"new_duplicate_of": F.when(~own, root), "new_independent": F.when(own, 1).otherwise(0)})


def claims(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Rollup of observations to claims: mentions, independent sources, representative row."""
    best = F.max_by("evidence_id", F.struct("independent", "verified", "confidence", -F.col("evidence_id")))
    return evidence.groupBy(*key).agg(F.count("*").alias("mention_count"), F.count_distinct(F.when(F.col("independent") == 1, F.col("source_id"))).alias("independent_source_count"), best.alias("representative"))


def set_hash(order: str, fields: list[str]) -> Column:
    """32 hex digits of the SHA-256 of a group's rows in order, their fields joined by bars."""
    line = F.concat_ws("|", *[F.col(f).cast("string") for f in fields])
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line"))))
    return F.substring(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), ","), 256), 1, 32)


def chased(rows: DataFrame, id_col: str, parent: str) -> DataFrame:
    """(id, root, problem): pointers followed to their end by doubling; ``problem`` is "cycle", "missing" or null.

    A pointer to a row that doesn't exist ends there. Rows on or before a cycle have a null root.
    """
    ids = rows.select(F.col(id_col).alias("id"), F.col(parent).alias("to"))
    known = ids.select(F.col("id").alias("to"), F.lit(True).alias("there"))
    state = ids.join(known, "to", "left").select("id", F.coalesce("to", "id").alias("at"), (F.col("to").isNotNull() & F.col("there").isNull()).alias("missing"), F.col("to").isNull().alias("done"))
    state = cut(state.withColumn("done", F.col("done") | F.col("missing")))
    rounds, total = 0, state.count()
    while state.where("not done").limit(1).count() and 2**rounds <= 2 * total:
        nxt = state.select(F.col("id").alias("at"), F.col("at").alias("then"), F.col("missing").alias("then_missing"), F.col("done").alias("then_done"))
        moved = state.join(nxt, "at", "left").select("id", F.when(F.col("done"), F.col("at")).otherwise(F.col("then")).alias("at"), F.when(F.col("done"), F.col("missing")).otherwise(F.col("then_missing")).alias("missing"), (F.col("done") | F.col("then_done")).alias("done"))
        state, rounds = cut(moved), rounds + 1
    problem = F.when(~F.col("done"), "cycle").when(F.col("missing"), "missing")
    return state.select("id", F.when(F.col("done"), F.col("at")).alias("root"), problem.alias("problem"))

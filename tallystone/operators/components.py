"""Connected components of links between rows, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.sources.exports import cut

#: Rounds that go by id, which settles stars; the others go by a hash that is new in each round.
ID_ROUNDS = 2


def shared_key_links(rows: DataFrame, group: str, keys: list[str], id_col: str) -> DataFrame:
    """(a, b): each row and the least id that has the same key in the same group; rows without a key have no link."""
    out = None
    for key in keys:
        own = rows.where(F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(id_col).alias("a"))
        least = own.groupBy("g", "k").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        found = own.join(least, ["g", "k"]).where("a <> b").select("a", "b")
        out = found if out is None else out.unionByName(found)
    return out


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for the ends of links (a, b: long); the component is the least id among those connected.

    A round points every node at its neighbour of least rank, itself included, then at where that points, and
    rewrites the links. With ranks drawn anew a path loses more than half of its nodes a round on average,
    whatever the order of its ids. Tables of all rounds are in the shared folder.
    """

    def rank(node: str, turn: int) -> Column:
        return F.col(node) if turn < ID_ROUNDS else F.xxhash64(F.lit(turn), F.col(node))

    left = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    turns: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(turns)
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*")
        lowest = F.least(F.min(F.struct(rank("other", turn).alias("rank"), F.col("other").alias("id"))), F.struct(rank("id", turn).alias("rank"), F.col("id")))
        step = cut(ends.groupBy("id").agg(lowest.alias("low")).select("id", F.col("low.id").alias("at")))
        step = cut(step.join(step.select(F.col("id").alias("at"), F.col("at").alias("next")), "at").select("id", F.col("next").alias("at")))
        turns.append(step)
        joined = left.join(step.select(F.col("id").alias("a"), F.col("at").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("at").alias("y")), "b")
        left = cut(joined.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not turns:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = turns.pop().select("id", F.col("at").alias("component"))
    while turns:
        out = cut(turns.pop().join(out.withColumnRenamed("id", "at"), "at", "left").select("id", F.coalesce("component", "at").alias("component")))
    least = out.groupBy("component").agg(F.min("id").alias("least"))
    return out.join(least, "component").select("id", F.col("least").alias("component"))

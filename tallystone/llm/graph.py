"""Connected components of an edge table, without a driver-side edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.scratch import Scratch

#: Rounds in which the least id leads; later ones go by a hash of the id that differs from round to round.
BY_ID = 2


def _rank(node: str, k: int) -> Column:
    return F.col(node) if k < BY_ID else F.xxhash64(node, F.lit(k))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of ``edges`` (long columns a, b); comp is the least node connected to it.

    Each round hooks every node to the neighbour of least rank (itself included), follows two hooks, and rewrites
    the edges between where they lead. Ranks are ids in the first two rounds, which is enough for stars, and then
    hashes drawn anew each round: of a path, whatever the order of its ids, a round then leaves less than half of
    the nodes on average, so rounds grow with the logarithm of the longest path. Only whether edges are left
    reaches the driver. Self loops and repeated edges are allowed; an empty table gives an empty table.
    """
    live = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges-0")
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        k = len(hooks)
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        low = F.least(F.min(F.struct(_rank("other", k).alias("rank"), F.col("other").alias("to"))), F.struct(_rank("node", k).alias("rank"), F.col("node").alias("to")))
        near = scratch.save(both.groupBy("node").agg(low.alias("low")).select("node", F.col("low.to").alias("to")), f"{name}-near-{k}")
        # every node that is hooked to has an edge, and so a hook of its own
        hook = scratch.save(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to")), f"{name}-hooks-{k}")
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = live.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        live = scratch.save(moved, f"{name}-edges-{k + 1}")
    if not hooks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    # from the last round backwards: each round's table is a fraction of the one before
    out = hooks[-1].select("node", F.col("to").alias("comp"))
    for k in range(len(hooks) - 2, -1, -1):
        out = hooks[k].join(out.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("comp", "to").alias("comp"))
        if k % 4 == 3:
            out = scratch.save(out, f"{name}-back-{k}")
    if len(hooks) > BY_ID:
        out = scratch.save(out, f"{name}-led")
        least = out.groupBy("comp").agg(F.min("node").alias("least"))
        out = out.join(least, "comp").select("node", F.col("least").alias("comp"))
    return scratch.save(out, f"{name}-comps")

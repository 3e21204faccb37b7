"""Places in one order over a whole table, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.sources.exports import cut

#: The bits of a number by monotonically_increasing_id that count the rows of a partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """The rows with their place (from 1) in ``order``, which must be total.

    Rows are dealt to partitions by ranges of the order, sorted there and numbered within; the partitions' sizes,
    one row each, give where each of them starts. The table is written once in between, so that numbers stay.
    """
    if "_at" in rows.columns or "_part" in rows.columns:
        raise ValueError("_at and _part are names of this operator")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    held = cut(dealt.withColumns({"_part": F.shiftright(at, _ROW_BITS), "_at": at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}))
    sizes = held.groupBy("_part").agg(F.count("*").alias("n"))
    starts = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_start"))
    # one row for each partition: small enough to be sent to every executor
    return held.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")

"""Positions in one order over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Rows up to which one task ranks them all.
IN_ONE = 1_000_000
_PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, *order: str, to: str = "_rank", in_one: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with their positions, from 0, in the order of the named columns, and how many
    they are. Beyond ``in_one`` rows: a distributed prefix sum. Rows are dealt by ranges and sorted
    there, numbered within their partition, and each partition's start, the rows in those
    before it, is added; starts are a row for each partition."""
    n = rows.count()
    if n <= (IN_ONE if in_one is None else in_one):
        return rows.withColumn(to, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint")), n
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # written, as ranges are drawn by sampling: numbers and starts must be of one division
    laid = written(laid, "ranks").withColumn("_part", F.shiftright("_id", 33))
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = laid.join(F.broadcast(starts), "_part").withColumn(to, F.col("_start") + F.col("_id").bitwiseAND(F.lit(_PLACE)))
    return placed.drop("_part", "_start", "_id"), n

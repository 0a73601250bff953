"""Numbering of a whole table in an order, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axisframe.store import written


def numbered(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name``: 0, 1, ... in the order: a range per task, each numbered from its ranges before.

    The sorted ranges are written once, so that every reader sees the same cuts.
    """
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    # the id is (range << 33) + place in the range
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    return placed.join(offsets, F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_place")).drop("_id", "_part", "_place", "_p", "_before")

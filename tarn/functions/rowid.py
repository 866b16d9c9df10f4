"""Dense row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import durable


def with_row_id(df: DataFrame, order: Sequence[str | Column] = (), out: str = "_row_id") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order, or in scan order.

    Rows are numbered inside their partition; only the row counts of the
    partitions are added up in one place.
    """
    placed = (df.orderBy(*order) if order else df).withColumn("_pos", F.monotonically_increasing_id())
    placed = durable(placed).withColumn("_block", F.shiftright("_pos", 33))
    sizes = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_block")  # one row per partition
    local = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(out, F.col("_before") + local).drop("_pos", "_block", "_before")

"""Ordered computations that hold up when one key owns much of the data.

A window partitioned by a hot key (or by nothing) sorts all its rows in one
task. Here the rows are sorted globally and range-partitioned, every sort
partition is one block, and a hot key spreads over many blocks. Each block
works alone; what crosses block borders is one summary row per block and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import durable

_ROWS_BITS = 33


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Sort by ``keys`` and ``order`` (which together must be unique) and number
    the rows: ``_block`` is the sort partition, ``_pos`` the global position id.

    The result is written to the shared scratch folder: block numbers must not
    change when a lost task is recomputed.
    """
    placed = df.orderBy(*keys, *order).withColumn("_pos", F.monotonically_increasing_id())
    return durable(placed.withColumn("_block", F.shiftright("_pos", _ROWS_BITS).cast("int")))


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``_block`` and keys, null keys matching null keys."""
    renamed = right.select(
        F.col("_block").alias("_rb"),
        *[F.col(k).alias(f"_rk{i}") for i, k in enumerate(keys)],
        *[c for c in right.columns if c not in ("_block", *keys)],
    )
    cond = left["_block"] == renamed["_rb"]
    for i, k in enumerate(keys):
        cond = cond & left[k].eqNullSafe(renamed[f"_rk{i}"])
    return left.join(renamed, cond, "left").drop("_rb", *[f"_rk{i}" for i in range(len(keys))])


def _running(blocks: DataFrame, keys: Sequence[str], value: Column, out: str, agg, combine,
             exclusive: bool) -> DataFrame:
    totals = blocks.groupBy("_block", *keys).agg(agg(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = totals.select("_block", *keys, agg(F.col("_total")).over(before).alias("_carry"))
    frame = Window.partitionBy("_block", *keys).orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0
    )
    local = blocks.withColumn("_local", agg(value).over(frame))
    joined = _join_on(local, carried, keys)
    return joined.withColumn(out, combine(F.col("_carry"), F.col("_local"))).drop(
        "_carry", "_local"
    )


def running_sum(blocks: DataFrame, keys: Sequence[str], value: Column, out: str,
                exclusive: bool = False) -> DataFrame:
    """Running sum per key in block order."""
    return _running(
        blocks, keys, value, out, F.sum,
        lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), exclusive,
    )


def running_max(blocks: DataFrame, keys: Sequence[str], value: Column, out: str,
                exclusive: bool = False) -> DataFrame:
    """Running maximum per key in block order."""
    return _running(blocks, keys, value, out, F.max, lambda a, b: F.greatest(a, b), exclusive)


def carry_last(blocks: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """The last non-null ``value`` of the key up to and including each row."""
    lasts = blocks.groupBy("_block", *keys).agg(F.max_by(value, F.when(value.isNotNull(), F.col("_pos"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = lasts.select(
        "_block", *keys, F.last("_last", ignorenulls=True).over(before).alias("_carry")
    )
    frame = Window.partitionBy("_block", *keys).orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = blocks.withColumn("_local", F.last(value, ignorenulls=True).over(frame))
    return _join_on(local, carried, keys).withColumn(
        out, F.coalesce("_local", "_carry")
    ).drop("_carry", "_local")


def previous(blocks: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """``value`` of the preceding row of the key, null for its first row."""
    boxed = F.struct(value.alias("v"))
    lasts = blocks.groupBy("_block", *keys).agg(F.max_by(boxed, F.col("_pos")).alias("_last"))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    carried = lasts.select("_block", *keys, F.lag("_last").over(by_block).alias("_carry"))
    frame = Window.partitionBy("_block", *keys).orderBy("_pos")
    local = blocks.withColumn("_local", F.lag(boxed).over(frame))
    return _join_on(local, carried, keys).withColumn(
        out, F.coalesce("_local", "_carry")["v"]
    ).drop("_carry", "_local")


def drop_order(df: DataFrame) -> DataFrame:
    return df.drop("_block", "_pos")

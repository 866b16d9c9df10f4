"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is small, else as it is: Spark then
    joins by shuffling, with its own handling of skew."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread(scan: DataFrame) -> DataFrame:
    """A table scan in at least as many partitions as there are cores.

    A small table, or one in a few large row groups, would run the work that
    follows in a few tasks. A scan with enough partitions is left alone, so a
    large table is not shuffled. Only for scans, also those joined with a broadcast
    table: looking at the partitions of a plan with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan

"""Connected components of a link table, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node.

    Alternates two rounds of edge rewriting: a node's larger neighbours are hung on its
    smallest neighbour, then its smaller ones are. Both are aggregates by node with
    partial results before the shuffle, so a hub with many links is no single task's
    work; the number of rounds grows with the logarithm of the longest chain. Nothing but
    two numbers a round reaches the driver.
    """
    edges = durable(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = durable(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        found = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = small
        if found == state:
            break
        state = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )

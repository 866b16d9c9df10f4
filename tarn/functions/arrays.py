"""In-row sequence helpers built from higher-order functions.

A document is one row, so per-document sequential work (running offsets,
greedy packing) is done inside the row: no explode, no shuffle, no sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def indexes(arr: Column) -> Column:
    """``[0 .. size-1]``, empty for an empty array."""
    return F.transform(arr, lambda _, i: i)


def prefix_states(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold ``items`` from the left and keep every state, ``zero`` first.

    Appending to an array copies it, so the fold runs over blocks: the copies
    stay short and the cost is near linear in the number of items.
    """
    def cut(arr: Column) -> Column:
        last = (F.ceil(F.size(arr) / F.lit(_BLOCK)) - 1).cast("int")
        return F.when(
            F.size(arr) > 0,
            F.transform(
                F.sequence(F.lit(0), last), lambda b: F.slice(arr, b * _BLOCK + 1, F.lit(_BLOCK))
            ),
        ).otherwise(F.slice(F.array(arr), 1, 0))

    def fold_block(done: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            F.array(F.element_at(done, -1)),
            lambda seen, x: F.array_append(seen, step(F.element_at(seen, -1), x)),
            lambda seen: F.concat(done, F.slice(seen, 2, _BLOCK)),
        )

    return F.aggregate(let(items, cut), F.array(zero), fold_block)


def tail(arr: Column) -> Column:
    """All but the first element."""
    return let(arr, lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))))


def running_offsets(lengths: Column) -> Column:
    """Exclusive running sums as longs; one more element than ``lengths``."""
    return prefix_states(
        lengths, F.lit(0).cast("long"), lambda total, n: total + n.cast("long")
    )


def runs(flags: Column) -> Column:
    """Maximal runs of true flags as ``array<struct<first int, last int>>``."""

    def edges(f: Column) -> Column:
        firsts = F.filter(
            indexes(f), lambda i: f[i] & ~F.coalesce(F.get(f, i - 1), F.lit(False))
        )
        lasts = F.filter(
            indexes(f), lambda i: f[i] & ~F.coalesce(F.get(f, i + 1), F.lit(False))
        )
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    return let(flags, edges)


def explode_rows(df: DataFrame, keep: list[str], arr: Column | str, pos: str, item: str) -> DataFrame:
    """One row per element with its 0-based position.

    The outer form with a null filter, because a plain explode makes the
    optimizer add a ``size(arr) > 0`` filter below it, which evaluates an
    expensive array expression twice.
    """
    return (
        df.select(*keep, F.posexplode_outer(arr).alias(pos, item))
        .filter(F.col(pos).isNotNull())
        .withColumn(pos, F.col(pos).cast("long"))
    )

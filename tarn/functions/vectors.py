"""Vector expressions over ``array<float>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column) -> Column:
    """Unit-length copy; a zero vector is returned as it is."""
    from tarn.functions.arrays import let

    return let(
        norm(a),
        lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(
            a.cast("array<double>")
        ),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(
        _sum(
            F.zip_with(
                a,
                b,
                lambda x, y: (x.cast("double") - y.cast("double"))
                * (x.cast("double") - y.cast("double")),
            )
        )
    )


def mrl_truncate(a: Column, n: int) -> Column:
    """First ``n`` dimensions, normalised again."""
    return l2_normalize(F.slice(a, 1, n))

"""Rollups over event and task logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.sizes import broadcast_if_small
from tarn.session import durable

# --- fixed values: histogram buckets in seconds ---------------------------------------------
BUCKETS = {
    "embedding_seconds": [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0],
    "index_sync_seconds": [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0],
    "reconcile_seconds": [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0],
    "search_seconds": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0],
}

# --- fixed values: metric, kind, label ---------------------------------------------------------
METRICS = [
    ("pipeline_entities_total", "counter", "status"),
    ("pipeline_chunks_total", "counter", None),
    ("embedding_seconds", "histogram", "batch_size"),
    ("pipeline_errors_total", "counter", "stage"),
    ("index_parquet_writes_total", "counter", None),
    ("index_syncs_total", "counter", "status"),
    ("index_sync_seconds", "histogram", None),
    ("index_rebuilds_total", "counter", None),
    ("index_chunks_indexed_total", "counter", None),
    ("sync_enqueue_total", "counter", None),
    ("sync_dequeue_total", "counter", "status"),
    ("sync_retry_total", "counter", None),
    ("sync_queue_depth", "gauge", None),
    ("sync_worker_errors_total", "counter", None),
    ("reconcile_scans_total", "counter", None),
    ("reconcile_drifts_total", "counter", "drift_type"),
    ("reconcile_repairs_total", "counter", "drift_type"),
    ("reconcile_seconds", "histogram", None),
    ("search_queries_total", "counter", "search_type"),
    ("search_seconds", "histogram", "search_type"),
    ("search_results_returned_total", "counter", "search_type"),
    ("entity_ops_total", "counter", "operation"),
]


def histogram(df: DataFrame, buckets: Sequence[float], value: str = "value", *labels: str) -> DataFrame:
    """Cumulative bucket counts with an infinite last bucket, plus sum and count.

    All buckets are counted in one aggregate and turned to rows afterwards.
    """
    bounds = [*buckets, float("inf")]
    counted = df.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.sum(value).alias("total"),
        F.count(value).alias("n"),
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(b).cast("double").alias("le"), F.col(f"_b{i}").alias("cumulative"))
                for i, b in enumerate(bounds)
            ]
        )
    )
    return counted.select(*labels, "total", "n", rows.alias("_r")).select(*labels, "_r.*", "total", "n")


def ops_metrics(log: DataFrame) -> DataFrame:
    """All metrics from one log of ``metric, label, value, ts`` observations.

    Counters add up, a gauge is its last value, histograms report count and sum;
    their buckets come from :func:`histogram`.
    """
    kinds = {name: kind for name, kind, _ in METRICS}
    gauges = [n for n, k in kinds.items() if k == "gauge"]
    known = log.filter(F.col("metric").isin(*kinds))
    return known.groupBy("metric", F.coalesce("label", F.lit("")).alias("label")).agg(
        F.when(F.first("metric").isin(*gauges), F.max_by("value", "ts")).otherwise(F.sum("value")).alias("value"),
        F.count(F.lit(1)).alias("observations"),
    )


def watch_status(events: DataFrame, now: Column) -> DataFrame:
    """Per strategy: events of the last hour, P99 of the lag, entities managed.

    The percentile is exact. A summary of bounded size gives bounds around it, and the
    values between them, a thousandth of a strategy's, are counted and put in order.
    Entities are counted apart: in one aggregate each would carry a summary of its own.
    """
    recent = (F.col("ts") > now - F.make_interval(hours=F.lit(1))) & (F.col("ts") <= now)
    bounds = F.percentile_approx("lag", [0.9895, 0.9905], 10_000)
    seen = durable(
        events.groupBy("strategy_id").agg(F.count_if(recent).alias("events_last_hour"), F.count("lag").alias("_n"), bounds.alias("_b"))
    )
    near = broadcast_if_small(seen.select(F.col("strategy_id").alias("_s"), "_n", "_b"), 500_000)
    lags = events.where("lag IS NOT NULL").join(near, F.col("strategy_id").eqNullSafe(F.col("_s")))
    # What lies below the bounds is one row, of no value.
    value = F.when(F.col("lag") >= F.col("_b")[0], F.col("lag"))
    counted = lags.where(F.col("lag") <= F.col("_b")[1]).groupBy("strategy_id", value.alias("lag")).agg(
        F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")
    )
    upto = F.sum("_c").over(Window.partitionBy("strategy_id").orderBy(F.asc_nulls_first("lag")))
    reached = counted.withColumn("_upto", upto).where(F.col("_upto") >= F.expr("_n - _n div 100"))
    ninety_ninth = reached.groupBy("strategy_id").agg(F.min("lag").alias("lag_p99"))
    managed = events.select("strategy_id", "entity_id").where("entity_id IS NOT NULL").distinct().groupBy("strategy_id")
    parts = seen.select("strategy_id", "events_last_hour")
    for part in (ninety_ninth, managed.agg(F.count(F.lit(1)).alias("entities_managed"))):
        parts = parts.unionByName(part, allowMissingColumns=True)
    return parts.groupBy("strategy_id").agg(
        F.max("events_last_hour").alias("events_last_hour"),
        F.max("lag_p99").alias("lag_p99"),
        F.coalesce(F.max("entities_managed"), F.lit(0)).alias("entities_managed"),
    )


def dead_letter_alerts(letters: DataFrame, burst: int = 100, days: int = 7, size_cap: int | None = None) -> DataFrame:
    """Alerts: more than ``burst`` letters in an hour; new letters of a strategy on
    ``days`` days running; total size above nine tenths of the cap."""
    hourly = letters.groupBy(F.window("created_at", "1 hour")["start"].alias("at")).agg(F.count(F.lit(1)).alias("n"))
    bursts = hourly.filter(F.col("n") > burst).select(
        F.lit("burst").alias("alert"), F.lit("").alias("strategy_id"), F.col("at"), F.col("n")
    )
    # One row per strategy and day: islands of consecutive days.
    daily = letters.select("strategy_id", F.to_date("created_at").alias("d")).distinct()
    numbered = daily.withColumn(
        "_island",
        F.date_sub("d", F.row_number().over(Window.partitionBy("strategy_id").orderBy("d"))),
    )
    stale = (
        numbered.groupBy("strategy_id", "_island").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
        .filter(F.col("n") >= days)
        .select(F.lit("stale").alias("alert"), "strategy_id", F.col("d").cast("timestamp").alias("at"), "n")
    )
    alerts = bursts.unionByName(stale)
    if size_cap is not None:
        full = letters.agg(F.sum("size").alias("n"), F.max("created_at").alias("at")).filter(
            F.col("n") > size_cap * 0.9
        ).select(F.lit("disk_full").alias("alert"), F.lit("").alias("strategy_id"), "at", F.col("n").cast("long").alias("n"))
        alerts = alerts.unionByName(full)
    return alerts

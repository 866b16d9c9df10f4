"""The sync task log: dedup, retry, recovery, compaction, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarn.functions.ordered import ordered_blocks, running_sum
from tarn.session import durable, scratch

TASK_KEY = ["workspace_id", "collection_id", "entity_id", "rep_name"]


def dedup_tasks(log: DataFrame, keys: Sequence[str] = TASK_KEY, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Tasks after deduplication of an enqueue log.

    An enqueue while a task of the same key is pending only raises ``attempts``;
    after the task ended (``done`` or ``failed``) the next one is new. ``log`` has
    ``op`` (enqueue / done / failed) and ``task_id``. Counting the ends before
    each row numbers the tasks of a key, also when one key fills most of the log.
    """
    ends = F.col("op").isin("done", "failed")
    numbered = running_sum(
        ordered_blocks(log, keys, order), keys, ends.cast("long"), "_task", exclusive=True
    )
    first = order[0] if len(order) == 1 else F.struct(*order)
    return (
        numbered.groupBy(*keys, "_task")
        .agg(
            F.min_by(F.when(F.col("op") == "enqueue", F.col("task_id")), F.when(F.col("op") == "enqueue", F.col(first) if isinstance(first, str) else first)).alias("task_id"),
            (F.count_if(F.col("op") == "enqueue") - 1).alias("attempts"),
            F.coalesce(F.max(F.when(ends, F.col("op"))), F.lit("pending")).alias("status"),
        )
        .filter(F.col("task_id").isNotNull())
        .drop("_task")
    )


def dedup_stream(stream: DataFrame, keys: Sequence[str] = TASK_KEY, ts: str = "ts") -> DataFrame:
    """Running form of :func:`dedup_tasks`: the tasks each batch of the log changed, with
    their attempts and status so far.

    The state of a key is its pending task; ``done`` or ``failed`` removes it, so what is
    kept grows with the pending tasks only. Rows of a batch are taken by ``ts``, then
    ``task_id``, batches as they arrive. The last row of a key and task holds. Use with
    output mode ``update``.
    """
    keys = list(keys)
    columns = [*keys, "task_id", "attempts", "status"]

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values([ts, "task_id"])
        pending = state.get if state.exists else None
        enqueued, found = False, []
        for op, task_id in zip(rows["op"], rows["task_id"], strict=True):
            if op == "enqueue":
                pending = (pending[0], pending[1] + 1) if pending else (task_id, 0)
                enqueued = True
            elif op in ("done", "failed") and pending:
                found.append((*key, *pending, op))
                pending = None
        if pending and enqueued:
            found.append((*key, *pending, "pending"))
            state.update(pending)
        elif not pending and state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=columns)

    names = [stream.schema[k] for k in keys]
    task = stream.schema["task_id"].dataType
    kept = StructType().add("task_id", task).add("attempts", "long")
    changed = StructType(names).add("task_id", task).add("attempts", "long").add("status", "string")
    needed = stream.select(*dict.fromkeys([*keys, "op", ts, "task_id"]))
    return needed.groupBy(*keys).applyInPandasWithState(follow, changed, kept, "update", "NoTimeout")


def no_tasks(rows: DataFrame, keys: Sequence[str] = TASK_KEY, ts: str = "ts") -> DataFrame:
    """The empty table of pending tasks for a log like ``rows``."""
    at = F.col(ts)
    return rows.where(F.lit(False)).select(
        *keys, "task_id", F.lit(0).cast("long").alias("attempts"), at.alias("since"), at.alias("seen")
    )


def fold_tasks(rows: DataFrame, pending: DataFrame, keys: Sequence[str] = TASK_KEY, ts: str = "ts",
               expire_after: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The tasks that a stretch of the log changed, and the pending ones after it.

    ``pending`` (keys, ``task_id, attempts, since, seen``: the times of the first and last
    enqueue) sums up the log before ``rows``: a pending task counts as one enqueue with the
    weight of all it stands for, so stretches of any length compose. Rows are taken by ``ts``
    (null first), ``task_id``, enqueues before ends. Ends without a task, other operations
    and columns play no part; equal enqueues each count as an attempt.

    Equal rows collapse before the shuffle, and a key is not worked on by one task: rows
    are sorted over all keys and only sums cross the borders of the sort partitions.

    With ``expire_after`` tasks whose last enqueue lies that far before the newest row end as
    ``expired``.
    """
    keys = list(keys)
    rows = rows.where(F.col("op").isin("enqueue", "done", "failed")).select(*keys, F.col(ts).alias("since"), "task_id", "op")
    rows = durable(rows.groupBy(*keys, "since", "task_id", "op").agg(F.count(F.lit(1)).alias("weight")))
    named = rows.select(*keys).distinct().select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    earlier = pending.join(named, match, "left_semi").select(
        *keys, "since", "task_id", F.lit("enqueue").alias("op"), (F.col("attempts") + 1).alias("weight"), "seen",
        F.lit(False).alias("_new"),
    )
    both = earlier.unionByName(rows.withColumns({"seen": F.col("since"), "_new": F.lit(True)}))
    ends = F.col("op") != "enqueue"
    blocks = ordered_blocks(both, keys, ["_new", "since", "task_id", ends, "op"])
    numbered = running_sum(blocks, keys, ends.cast("long"), "_task", exclusive=True)
    first = F.when(~ends, F.struct("_new", "since", "task_id"))
    folded = numbered.groupBy(*keys, "_task").agg(
        F.min(first).alias("_first"), (F.sum(F.when(~ends, F.col("weight"))) - 1).alias("attempts"),
        F.max_by(F.when(~ends, F.col("seen")), F.when(~ends, F.struct("_new", "seen"))).alias("seen"),
        F.max(F.when(ends, F.col("op"))).alias("status"),
    )
    folded = durable(
        folded.where("_first is not null").select(*keys, "_first.task_id", "attempts", "_first.since", "seen", "status")
    )
    columns = [*keys, "task_id", "attempts", "since", "seen"]
    going_on = pending.join(named, match, "left_anti").select(*columns).unionByName(folded.where("status is null").select(*columns))
    changed = folded.select(*keys, "task_id", "attempts", F.coalesce("status", F.lit("pending")).alias("status"))
    if expire_after is None:
        return changed, going_on
    newest = rows.agg(F.max("since")).first()[0]
    old = F.coalesce(F.col("seen") < F.lit(newest) - expire_after, F.lit(False))
    expired = going_on.where(old).select(*keys, "task_id", "attempts", F.lit("expired").alias("status"))
    # A task that this stretch changed and that is old already is told once, as expired.
    told = changed.where("status <> 'pending'").unionByName(expired)
    fresh = folded.where(F.col("status").isNull() & ~old).select(*keys, "task_id", "attempts", F.lit("pending").alias("status"))
    return told.unionByName(fresh), going_on.where(~old)


def follow_tasks(stream: DataFrame, state_path: str, checkpoint: str, handle: Callable[[DataFrame, int], None],
                 keys: Sequence[str] = TASK_KEY, ts: str = "ts", expire_after: Column | None = None) -> StreamingQuery:
    """:func:`fold_tasks` over a stream, until all that is there is read. ``handle`` gets the
    changed tasks and the number of each batch; a batch that failed is handed over again
    under its number.

    Unlike :func:`dedup_stream` a batch may hold any number of rows of one key, and tasks
    that never end expire. The pending tasks after batch N lie in ``epoch=N`` below
    ``state_path`` and are written before the batch counts as done, so a batch that runs
    again starts from the same tasks; the tables of earlier batches are for a lifecycle rule.
    """
    needed = stream.select(*dict.fromkeys([*keys, "op", ts, "task_id"]))

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        nothing = no_tasks(batch, keys, ts)
        # Before the first batch there is no table; a later one has to be there.
        before = spark.read.schema(nothing.schema).parquet(f"{state_path}/epoch={epoch - 1}") if epoch else nothing
        with scratch(spark):
            changed, pending = fold_tasks(batch, before, keys, ts, expire_after)
            pending.write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
            handle(changed, epoch)

    query = (
        needed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def next_attempts(tasks: DataFrame, max_attempts: int | Column = 5, cap: int = 60) -> DataFrame:
    """State after a failure: attempts + 1, then a back-off of ``min(2^attempts, cap)``
    seconds, or failed for good."""
    attempts = F.col("attempts") + 1
    limit = F.lit(max_attempts) if isinstance(max_attempts, int) else max_attempts
    retry = attempts < limit
    wait = F.least(F.pow(F.lit(2.0), attempts), F.lit(float(cap))).cast("long")
    return (
        tasks.withColumn("status", F.when(retry, F.lit("pending")).otherwise(F.lit("failed")))
        .withColumn("retry_in", F.when(retry, wait))
        .withColumn("retry_at", F.when(retry, F.col("last_attempt_at") + F.make_interval(secs=wait)))
        .withColumn("attempts", attempts)
    )


def latest_per_task(log: DataFrame, seq: str = "seq", task: str = "task_id") -> DataFrame:
    """The last log row of each task, found by a partial aggregate."""
    rest = [c for c in log.columns if c != task]
    return log.groupBy(task).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(task, "_r.*")


def compact_task_log(log: DataFrame, seq: str = "seq", task: str = "task_id") -> DataFrame:
    """Latest row per task, finished tasks left out."""
    return latest_per_task(log, seq, task).filter(F.lower("status") != "done")


def recover_tasks(log: DataFrame, seq: str = "seq", task: str = "task_id") -> DataFrame:
    """Tasks to run again after a restart, set back to pending."""
    open_now = F.lower("status").isin("pending", "running")
    return latest_per_task(log, seq, task).filter(open_now).withColumn("status", F.lit("pending"))


def queue_stats(log: DataFrame, *keys: str) -> DataFrame:
    """Counters over a task log with ``op``."""
    ops = ("enqueue", "done", "failed", "recovered")
    counted = log.groupBy(*keys).agg(*[F.count_if(F.col("op") == op).alias(op) for op in ops])
    return counted.select(
        *keys,
        F.col("enqueue").alias("enqueued"),
        F.col("done").alias("completed"),
        "failed",
        "recovered",
        (F.col("enqueue") + F.col("recovered") - F.col("done") - F.col("failed")).alias("pending"),
    )

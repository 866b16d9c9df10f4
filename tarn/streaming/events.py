"""Events and continuous index maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# --- fixed values: event types ---------------------------------------------------------
EVENT_SCHEMA = (
    "event_type string, workspace_id string, collection_id string, entity_id string, "
    "payload map<string,string>, ts timestamp"
)


def publish(events: DataFrame, path: str) -> None:
    """Append events to the event table, partitioned by type."""
    events.write.mode("append").partitionBy("event_type").parquet(path)


def subscribe(spark: SparkSession, path: str, *event_types: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """A stream of published events, of the given types or of all. Types are
    partitions: a subscriber lists and reads its own only."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.filter(F.col("event_type").isin(*event_types)) if event_types else stream


def maintain_index(stream: DataFrame, index_path: str, checkpoint: str, shards: int | None = None,
                   chunk: Callable[[DataFrame], DataFrame] | None = None, interval: str | None = None,
                   order: str | None = None) -> StreamingQuery:
    """Keep a written index current from a stream of staged chunks, or of documents
    with ``chunk``. A batch that is replayed replaces the same rows again.

    ``order`` names the column that tells the latest of several versions of a rep in a
    batch. A document that gives no chunk any more leaves the index.
    """
    from tarn.sources.index_table import REP_KEY, latest_reps, stored_shards, sync_index, write_chunk_index

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        latest = latest_reps(batch, order) if order else batch
        staged = chunk(latest) if chunk else latest
        if stored_shards(spark, index_path) is None:
            write_chunk_index(staged, index_path, shards)
        else:
            sync_index(spark, index_path, staged, touched=latest.select(*REP_KEY) if chunk else None)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query

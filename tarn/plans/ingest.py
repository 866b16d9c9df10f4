"""From files to searchable chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.located import FILE, ROW, at_places, stored
from tarn.functions.sizes import spread
from tarn.operators.chunking import ChunkConfig, chunk_documents, window_metadata
from tarn.operators.embedding import EmbedFn, embed
from tarn.operators.entities import ENTITY_KEY, decoded, new_entities, split_supported
from tarn.schema import ENTITY_COLUMNS
from tarn.session import durable


@dataclass
class Ingested:
    """Tables an ingest run produces. Contents have been hashed; chunks and vectors are computed
    when they are written."""

    entities: DataFrame
    reps: DataFrame
    chunks: DataFrame
    rejected: DataFrame
    log: DataFrame


def ingest(files: DataFrame, routes: DataFrame, now: Column, order: str, cfg: ChunkConfig | None = None,
           embedder: EmbedFn | None = None) -> Ingested:
    """``files`` has ``workspace_id, collection_id, name, content`` and an ``order``
    column that says which of two identical uploads came last.

    Copies collapse before anything is chunked. Contents are hashed in one pass and stay in
    their files; the last uploads are found by places (``functions/located.py``) and only
    their texts are read again, so no content is shuffled. Files without places are written
    to the shared folder first.
    """
    accepted, rejected = split_supported(stored(files), routes)
    uploads = new_entities(accepted.drop("entity_type", "format", "ext"), now)
    known = uploads.withColumn("size", F.length("content").cast("long")).drop("content")
    last = F.struct(F.col(order).isNotNull(), F.col(order), FILE, ROW)
    rest = [c for c in known.columns if c not in ENTITY_KEY]
    rows = durable(known.groupBy(*ENTITY_KEY).agg(F.max_by(F.struct(*rest), last).alias("_last")).select(*ENTITY_KEY, "_last.*"))
    # A table in fewer pieces than there are cores is dealt out before it is chunked.
    kept = spread(at_places(uploads, rows).select(*ENTITY_KEY, "content"))
    text = decoded(kept).select(*ENTITY_KEY, "text")
    keyed = rows.select("workspace_id", "collection_id", "entity_id", "content_hash", "size")
    source = keyed.select(
        "*", F.lit("source_original").alias("rep_type"), F.lit("").alias("transform"),
        F.lit("").alias("input_content_hash"), F.lit("active").alias("status"), F.lit("text").alias("modality"),
    )
    canonical = keyed.select(
        "*", F.lit("canonical_md").alias("rep_type"), F.lit("md_passthru").alias("transform"),
        F.col("content_hash").alias("input_content_hash"), F.lit("active").alias("status"), F.lit("text").alias("modality"),
    )
    chunks = window_metadata(chunk_documents(text, cfg)).withColumn("rep_name", F.lit("canonical_md"))
    chunks = chunks.withColumn("metadata", F.to_json("metadata"))
    if embedder is not None:
        chunks = embed(chunks, embedder)
    entities = rows.select(*ENTITY_COLUMNS)
    rejected = rejected.drop(FILE, ROW)
    log = entities.select(*ENTITY_KEY, "version", "content_hash", now.alias("timestamp"), F.lit("ingest").alias("trigger"))
    return Ingested(entities, source.unionByName(canonical), chunks, rejected, log)


"""File changes: snapshot diff, watch, ingest, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.functions.ordered import drop_order, ordered_blocks, previous, running_sum
from tarn.operators.entities import filter_files
from tarn.session import durable

SNAPSHOT_SCHEMA = "path string, content_hash string, size bigint"
FOLDER_SCHEMA = f"{SNAPSHOT_SCHEMA}, modified_at timestamp"
#: Changed files that are named one by one when they are read.
NAMED_FILES = 10_000


# --- snapshots -----------------------------------------------------------------------


def snapshot(files: DataFrame) -> DataFrame:
    """``path, content_hash, size`` of listed files with contents."""
    return files.select(
        "path", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("size")
    )


def file_changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Created, modified and deleted paths between two snapshots; without an
    earlier one the first scan is a silent baseline."""
    current = after.select("path", F.col("content_hash").alias("_new"))
    if before is None:
        return current.filter(F.lit(False)).select(
            "path", F.lit("").alias("event_type"), F.col("_new").alias("content_hash")
        )
    old = before.select("path", F.col("content_hash").alias("_old"))
    both = old.join(current, "path", "full_outer")
    kind = (
        F.when(F.col("_old").isNull(), F.lit("created"))
        .when(F.col("_new").isNull(), F.lit("deleted"))
        .when(F.col("_old") != F.col("_new"), F.lit("modified"))
    )
    return both.select(
        "path", kind.alias("event_type"), F.coalesce("_new", "_old").alias("content_hash")
    ).filter(F.col("event_type").isNotNull())


def watch_once(spark: SparkSession, listing: DataFrame, state_path: str,
               handle: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """One scan of a watched folder: changes against the snapshot kept at
    ``state_path``, which is replaced once ``handle`` has taken them. If ``handle``
    fails, the next scan finds the same changes again."""
    now = durable(listing.select("path", "content_hash", "size"))
    return _settle(_kept(spark, state_path, SNAPSHOT_SCHEMA), now, state_path, handle)


def _kept(spark: SparkSession, state_path: str, schema: str) -> DataFrame | None:
    """The snapshot of the last scan, none before the first."""
    try:
        return spark.read.schema(schema).parquet(state_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _settle(before: DataFrame | None, now: DataFrame, state_path: str, handle: Callable[[DataFrame], None] | None) -> DataFrame:
    changes = durable(file_changes(before, now))
    if handle:
        handle(changes)
    now.write.mode("overwrite").parquet(state_path)
    return changes


def _folder(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    return files.load(folder)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, modified_at, location`` of all files below ``folder``; no file is opened.
    Spark's reader passes over empty files."""
    return _folder(spark, folder).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"),
        F.col("_metadata.file_path").alias("location"),
    )


def hash_files(spark: SparkSession, folder: str, chosen: DataFrame) -> DataFrame:
    """``path, content_hash`` of the ``chosen`` rows of :func:`list_files`.

    Files older than the oldest chosen one are not opened, and of up to ``NAMED_FILES`` chosen
    ones no others either. Files that are gone by now are left out.
    """
    size, oldest = chosen.agg(F.count(F.lit(1)), F.min("modified_at")).first()
    files = _folder(spark, folder).select("path", "modificationTime", "content", F.col("_metadata.file_path").alias("location"))
    if size <= NAMED_FILES:
        files = files.where(F.col("location").isin([r["location"] for r in chosen.select("location").collect()]))
    if size:
        files = files.where(F.col("modificationTime") >= F.lit(oldest))
    hashed = files.select("path", F.sha2("content", 256).alias("content_hash"))
    return hashed if size <= NAMED_FILES else hashed.join(chosen.select("path"), "path", "left_semi")


def watch_folder(spark: SparkSession, folder: str, state_path: str,
                 handle: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """:func:`watch_once` over the files below ``folder``, of which only those are opened whose
    size or time of change differs from the last scan: a scan of an unchanged folder reads no
    content. A file that is rewritten with both unchanged is not noticed; pass hashed listings
    to :func:`watch_once` where that can happen. A touched file with the same content is no
    change. A file that becomes empty or vanishes during the scan counts as deleted."""
    listed = durable(list_files(spark, folder))
    before = _kept(spark, state_path, FOLDER_SCHEMA)
    last = spark.createDataFrame([], FOLDER_SCHEMA) if before is None else before
    known = last.select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "modified_at", "content_hash")])
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified_at").eqNullSafe(F.col("_modified_at"))
    compared = durable(listed.join(known, "path", "left").withColumn("_same", same))
    hashed = hash_files(spark, folder, compared.where("not _same"))
    current = compared.join(hashed, "path", "left").withColumn(
        "content_hash", F.when(F.col("_same"), F.col("_content_hash")).otherwise(F.col("content_hash"))
    )
    now = durable(current.where("content_hash is not null").select("path", "content_hash", "size", "modified_at"))
    return _settle(before, now, state_path, handle)


def watch_created(spark: SparkSession, folder: str, extensions: Sequence[str], max_mb: float = 500,
                  blocked: Sequence[str] = ()) -> DataFrame:
    """A stream of new files with contents. The checkpoint of the query remembers
    which paths were seen; changed and deleted files need :func:`watch_once`."""
    files = (
        spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    )
    named = files.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    return filter_files(named, extensions, max_mb, blocked)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything there is now in micro-batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_continuous(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None],
                   interval: str = "5 seconds") -> StreamingQuery:
    """Keep processing, one micro-batch per poll interval."""
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start()
    )


# --- applying changes -------------------------------------------------------------------


def apply_changes(events: DataFrame, entities: DataFrame, on_conflict: str = "update") -> tuple[DataFrame, DataFrame]:
    """What to do with each file event, and events that are errors.

    Created files are ingested; modified ones too, unless conflicts are skipped or
    are errors; deletions are only logged. ``entities`` holds ``path``.
    """
    if on_conflict not in ("update", "skip", "error"):
        raise ValueError(f"unknown conflict policy {on_conflict!r}")
    known = entities.select("path").distinct().withColumn("_known", F.lit(True))
    joined = events.join(known, "path", "left")
    clash = (F.col("event_type") == "modified") | ((F.col("event_type") == "created") & F.coalesce("_known", F.lit(False)))
    action = (
        F.when(F.col("event_type") == "deleted", F.lit("log"))
        .when(clash, F.lit({"update": "ingest", "skip": "skip", "error": "error"}[on_conflict]))
        .otherwise(F.lit("ingest"))
    )
    decided = joined.withColumn("action", action).drop("_known")
    errors = decided.filter("action = 'error'").withColumn("error", F.lit("file already has an entity"))
    return decided.filter("action <> 'error'"), errors


def entity_key(df: DataFrame, strategy: str, template: str = "{date}-{filename}", path: str = "path",
               content_hash: str = "content_hash", date: str = "date") -> DataFrame:
    """``entity_id`` by naming strategy."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    if strategy == "filename":
        key = stem
    elif strategy == "filepath":
        key = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "\\.[^./]*$", ""), "^/+|/+$", ""), "/+", "-")
    elif strategy == "uuid":
        # Derived from the path, so that a retried task gives the same id.
        h = F.sha2(F.col(path), 256)
        key = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    elif strategy == "hash":
        key = F.concat(F.lit("sha256:"), F.col(content_hash))
    elif strategy == "template":
        key = F.lit(template)
        for slot, value in (("{date}", F.col(date)), ("{filename}", stem), ("{hash}", F.col(content_hash))):
            if slot in template:
                key = F.replace(key, F.lit(slot), value)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.withColumn("entity_id", key)


# --- bursts and repeats -------------------------------------------------------------------


def stable_files(df: DataFrame, now: Column, seconds: int = 30, mtime: str = "modified_at") -> DataFrame:
    """Files not written to for a while."""
    return df.filter(F.col(mtime) <= now - F.make_interval(secs=F.lit(seconds)))


def skip_unchanged(events: DataFrame, keys: Sequence[str], order: Sequence[str], tag: str = "content_hash") -> DataFrame:
    """Events whose content differs from the previous event of the same path."""
    blocks = ordered_blocks(events, keys, order)
    before = previous(blocks, keys, F.col(tag), "_before")
    return drop_order(before.filter(~F.col(tag).eqNullSafe(F.col("_before"))).drop("_before"))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def coalesce_events(events: DataFrame, keys: Sequence[str], gap_seconds: float, ts: str = "ts",
                    kind: str = "event_type", tie: str = "event_id") -> DataFrame:
    """Collapse runs of the same event type of one path less than a gap apart to
    their last event, with the number of events it stands for."""
    blocks = ordered_blocks(events, keys, [ts, tie])
    seen = previous(blocks, keys, F.struct(F.col(ts).alias("t"), F.col(kind).alias("k")), "_p")
    apart = _micros(F.col(ts)) - _micros(F.col("_p.t")) > int(gap_seconds * 1_000_000)
    opens = F.col("_p").isNull() | apart | (F.col("_p.k") != F.col(kind))
    numbered = running_sum(seen.withColumn("_open", opens.cast("long")).drop("_p"), keys, F.col("_open"), "_run")
    rest = [c for c in events.columns if c not in keys]
    return (
        numbered.groupBy(*keys, "_run")
        .agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_e"), F.count(F.lit(1)).alias("event_count"))
        .select(*keys, "_e.*", "event_count")
    )


def coalesce_stream(stream: DataFrame, key: str, gap: str = "30 seconds", delay: str = "1 minute",
                    ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """The streaming form: one row per session of a path and event type."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("session"), key, kind)
        .agg(F.count(F.lit(1)).alias("event_count"), F.max(ts).alias("last_ts"))
    )


def batch_ingest(events: DataFrame, size: int = 50, window: str = "5 seconds",
                 keys: Sequence[str] = ("workspace_id", "collection_id"), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Batch number of each event: per collection and flush window, ``size`` at most."""
    timed = events.withColumn("flush_at", F.window(ts, window)["end"])
    blocks = ordered_blocks(timed, [*keys, "flush_at"], [ts, tie])
    placed = running_sum(blocks, [*keys, "flush_at"], F.lit(1).cast("long"), "_n")
    return drop_order(placed.withColumn("batch", F.ceil(F.col("_n") / size))).drop("_n")


# --- dead letters -----------------------------------------------------------------------------


def dead_letters(errors: DataFrame, now: Column) -> DataFrame:
    """Quarantine rows for failed events."""
    return errors.select("*", now.alias("created_at"), F.lit(False).alias("replayed"))


def replay(letters: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Letters whose file still exists, to be ingested again, and the rest."""
    paths = listing.select("path").distinct()
    return letters.join(paths, "path", "left_semi"), letters.join(paths, "path", "left_anti")


def expire(letters: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Letters that are not older than ``hours``."""
    return letters.filter(F.col("created_at") >= now - F.make_interval(hours=F.lit(hours)))


def next_replay(letters: DataFrame, schedule: Sequence[int] = (300, 3600, 21600)) -> DataFrame:
    """Time of the next automatic replay; none once the schedule is used up."""
    waits = F.array(*[F.lit(s) for s in schedule])
    wait = F.get(waits, F.col("attempts").cast("int"))
    return letters.withColumn(
        "next_replay_at", F.col("last_retry_at") + F.make_interval(secs=wait)
    ).withColumn("permanent", wait.isNull())


def expire_dead_letters(letters: DataFrame, now: Column, days: int, strategy_cap: int, total_cap: int) -> tuple[DataFrame, DataFrame]:
    """Letters to keep and an audit row per deletion.

    First what is older than ``days`` goes, then the oldest until each strategy
    and then the whole are within their size caps.
    """
    fresh = letters.withColumn("_old", F.col("created_at") < now - F.make_interval(days=F.lit(days)))
    alive = fresh.filter(~F.col("_old")).drop("_old")
    newest = [F.desc("created_at"), F.desc("letter_id")]
    per = running_sum(ordered_blocks(alive, ["strategy_id"], newest), ["strategy_id"], F.col("size"), "_sum")
    within = drop_order(per.filter(F.col("_sum") <= strategy_cap)).drop("_sum")
    over = drop_order(per.filter(F.col("_sum") > strategy_cap)).drop("_sum")
    total = running_sum(ordered_blocks(within, [], newest), [], F.col("size"), "_sum")
    kept = drop_order(total.filter(F.col("_sum") <= total_cap)).drop("_sum")
    rest = drop_order(total.filter(F.col("_sum") > total_cap)).drop("_sum")

    def audit(df: DataFrame, reason: str) -> DataFrame:
        return df.select("letter_id", "strategy_id", "size", now.alias("deleted_at"), F.lit(reason).alias("reason"))

    log = (
        audit(fresh.filter("_old"), "ttl_expired")
        .unionByName(audit(over, "strategy_cap"))
        .unionByName(audit(rest, "total_cap"))
    )
    return kept, log

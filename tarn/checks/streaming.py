"""File change, task log, event and streaming queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.checks.base import ORACLES, query, table
from tarn.checks.entities import now, with_status
from tarn.checks.storage import CHUNKS_SQL
from tarn.operators.chunking import chunk_fixed
from tarn.session import scratch_path
from tarn.sources.corpus import few_tasks, write_files
from tarn.sources.index_table import read_chunk_index
from tarn.streaming import changes as W
from tarn.streaming import events as V
from tarn.streaming import tasks as T

CHANGES_SQL = """b AS (SELECT d.doc_id, d.lang, d.text, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
ev AS (
  SELECT doc_id, '/' || lang || '/' || doc_id || '.md' AS path,
         CASE WHEN lang = 'de' THEN 'created' WHEN lang = 'fr' THEN 'deleted' WHEN toxic = 1 THEN 'modified' END AS event_type,
         sha256(CASE WHEN toxic = 1 AND lang <> 'fr' THEN text || '!' ELSE text END) AS content_hash FROM b)"""


def snapshots(spark, sf):
    """French files disappear, German ones appear, toxic ones change."""
    base = with_status(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    path = F.concat_ws("/", F.lit(""), "workspace_id", F.concat("doc_id", F.lit(".md"))).alias("path")
    before = base.filter("workspace_id <> 'de'").select(path, F.col("text").cast("binary").alias("content"))
    changed = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = base.filter("workspace_id <> 'fr'").select(path, changed.cast("binary").alias("content"))
    return W.snapshot(before), W.snapshot(after)


@query("file_changes", f"WITH {CHANGES_SQL} SELECT path, event_type, content_hash FROM ev WHERE event_type IS NOT NULL")
def file_changes(spark, sf):
    return W.file_changes(*snapshots(spark, sf))


@query("watch_scans", f"WITH {CHANGES_SQL} SELECT 2 AS scan, path, event_type FROM ev WHERE event_type IS NOT NULL")
def watch_scans(spark, sf):
    state = scratch_path(spark, "watch")
    before, after = snapshots(spark, sf)
    scans = [W.watch_once(spark, listing, state).withColumn("scan", F.lit(i + 1)) for i, listing in enumerate((before, after, after))]
    return scans[0].unionByName(scans[1]).unionByName(scans[2]).select("scan", "path", "event_type")


@query(
    "watch_folder_scans",
    """SELECT DISTINCT 2 AS scan, lang, source, CASE lang WHEN 'de' THEN 'created' ELSE 'deleted' END AS event_type FROM documents WHERE lang IN ('de', 'fr')""",
)
def watch_folder_scans(spark, sf):
    """Texts as files by language and source: German ones come between two scans, French ones go."""
    folder, state = scratch_path(spark, "folder"), scratch_path(spark, "watch")
    docs = table(spark, sf, "documents").select("lang", "source", "text")

    def put(rows):
        rows.repartition("lang", "source").write.partitionBy("lang", "source").mode("append").text(folder)

    put(docs.where("lang <> 'de'"))
    scans = [W.watch_folder(spark, folder, state)]
    put(docs.where("lang = 'de'"))
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/lang=fr")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    scans += [W.watch_folder(spark, folder, state) for _ in range(2)]
    found = reduce(DataFrame.unionByName, [s.withColumn("scan", F.lit(i + 1)) for i, s in enumerate(scans)])
    part = [F.regexp_extract("path", f"/{c}=([^/]*)/", 1).alias(c) for c in ("lang", "source")]
    return found.select("scan", *part, "event_type").distinct()


@query(
    "apply_changes",
    f"""WITH {CHANGES_SQL} SELECT path, event_type, CASE event_type WHEN 'deleted' THEN 'log' WHEN 'modified' THEN 'skip' ELSE 'ingest' END AS action, 'skip' AS policy FROM ev WHERE event_type IS NOT NULL
UNION ALL SELECT path, event_type, CASE event_type WHEN 'deleted' THEN 'log' WHEN 'modified' THEN 'error' ELSE 'ingest' END, 'error' FROM ev WHERE event_type IS NOT NULL""",
)
def apply_changes(spark, sf):
    before, after = snapshots(spark, sf)
    events = W.file_changes(before, after).select("path", "event_type")
    skip, _ = W.apply_changes(events, before, "skip")
    fine, errors = W.apply_changes(events, before, "error")
    cols = ["path", "event_type", "action"]
    return skip.select(*cols, F.lit("skip").alias("policy")).unionByName(
        fine.select(*cols, F.lit("error").alias("policy"))).unionByName(errors.select(*cols, F.lit("error").alias("policy")))


@query(
    "entity_keys",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, substr(sha256(html), 1, 16) AS h FROM pages),
n AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, sha256(path) AS ph FROM p)
SELECT page_id, stem AS by_name, replace(trim(regexp_replace(path, '\.[^./]*$', ''), '/'), '/', '-') AS by_path,
       substr(ph, 1, 8) || '-' || substr(ph, 9, 4) || '-' || substr(ph, 13, 4) || '-' || substr(ph, 17, 4) || '-' || substr(ph, 21, 12) AS by_uuid,
       'sha256:' || h AS by_hash, '2024-02-01-' || stem AS by_template FROM n""",
)
def entity_keys(spark, sf):
    rows = table(spark, sf, "pages").select(
        "page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"),
        F.sha2("html", 256).substr(1, 16).alias("content_hash"), F.lit("2024-02-01").alias("date"),
    )
    for strategy, name in (("filename", "by_name"), ("filepath", "by_path"), ("uuid", "by_uuid"), ("hash", "by_hash"), ("template", "by_template")):
        rows = W.entity_key(rows, strategy).withColumnRenamed("entity_id", name)
    return rows.drop("path", "content_hash", "date")


@query("stable_files", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 SECOND")
def stable_files(spark, sf):
    clock = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return W.stable_files(table(spark, sf, "events"), clock, 30, "ts").select("event_id")


@query(
    "skip_unchanged",
    "SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type",
)
def skip_unchanged(spark, sf):
    return W.skip_unchanged(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id")


@query(
    "coalesce_events",
    """WITH o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) > 36000000000 OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS op
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(op) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o)
SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS event_count FROM r GROUP BY user_id, run, event_type""",
)
def coalesce_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return W.coalesce_events(events, ["user_id"], 36000).drop("ts")


@query(
    "batch_ingest",
    """SELECT event_id, ceil(row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, event_id) / 5.0)::bigint AS batch FROM events""",
)
def batch_ingest(spark, sf):
    return W.batch_ingest(table(spark, sf, "events"), 5, "6 hours", ["event_type"]).select("event_id", "batch")


# --- dead letters -----------------------------------------------------------------------


def letters(spark, sf):
    """Error events as dead letters."""
    return table(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("letter_id"), (F.col("user_id") % 10).alias("strategy_id"), F.col("ts").alias("created_at"),
        F.floor(F.col("value") * 100).alias("size"), F.col("user_id").alias("path"),
    )


@query(
    "dead_letters",
    """SELECT event_id AS letter_id, ts >= TIMESTAMP '2024-02-01' - INTERVAL 72 HOUR AS kept, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS can_replay
FROM events WHERE event_type = 'error'""",
)
def dead_letters(spark, sf):
    found = W.dead_letters(letters(spark, sf).drop("created_at"), now()).drop("created_at").join(
        letters(spark, sf).select("letter_id", "created_at"), "letter_id"
    )
    again, rest = W.replay(found, table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("path")))
    kept = W.expire(found, now(), 72).select("letter_id", F.lit(True).alias("k"))
    both = again.select("letter_id", F.lit(True).alias("can_replay")).unionByName(rest.select("letter_id", F.lit(False).alias("can_replay")))
    return both.join(kept, "letter_id", "left").select("letter_id", F.coalesce("k", F.lit(False)).alias("kept"), "can_replay")


@query(
    "next_replay",
    """SELECT event_id AS letter_id, coalesce(epoch(ts)::bigint + CASE user_id % 4 WHEN 0 THEN 300 WHEN 1 THEN 3600 WHEN 2 THEN 21600 END, -1) AS next_at, user_id % 4 = 3 AS permanent
FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'error')""",
)
def next_replay(spark, sf):
    rows = letters(spark, sf).select(
        "letter_id", (F.col("path") % 4).alias("attempts"), F.date_trunc("second", "created_at").alias("last_retry_at")
    )
    return W.next_replay(rows).select(
        "letter_id", F.coalesce(F.unix_timestamp("next_replay_at"), F.lit(-1).cast("long")).alias("next_at"), "permanent"
    )


@query(
    "expire_dead_letters",
    """WITH l AS (SELECT event_id AS letter_id, user_id % 10 AS strategy_id, ts, floor(value * 100)::bigint AS size FROM events WHERE event_type = 'error'),
a AS (SELECT *, ts < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY AS old FROM l),
s AS (SELECT *, sum(size) OVER (PARTITION BY strategy_id ORDER BY ts DESC, letter_id DESC) AS ss FROM a WHERE NOT old),
t AS (SELECT *, sum(size) OVER (ORDER BY ts DESC, letter_id DESC) AS tt FROM s WHERE ss <= 60000)
SELECT letter_id, 'ttl_expired' AS fate FROM a WHERE old UNION ALL SELECT letter_id, 'strategy_cap' FROM s WHERE ss > 60000
UNION ALL SELECT letter_id, 'total_cap' FROM t WHERE tt > 300000 UNION ALL SELECT letter_id, 'kept' FROM t WHERE tt <= 300000""",
)
def expire_dead_letters(spark, sf):
    kept, log = W.expire_dead_letters(letters(spark, sf), now(), 20, 60000, 300000)
    return kept.select("letter_id", F.lit("kept").alias("fate")).unionByName(log.select("letter_id", F.col("reason").alias("fate")))


# --- tasks -----------------------------------------------------------------------------------

OP = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'enqueue' END"


def task_log(events):
    return events.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id")).alias("entity_id"),
        F.expr(OP).alias("op"), F.concat(F.lit("t"), F.col("event_id")).alias("task_id"),
    )


@query(
    "dedup_tasks",
    f"""WITH l AS (SELECT event_id AS seq, 'u' || user_id AS entity_id, {OP} AS op FROM events),
n AS (SELECT *, coalesce(sum(CASE WHEN op <> 'enqueue' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS task FROM l)
SELECT entity_id, 't' || min(seq) FILTER (WHERE op = 'enqueue') AS task_id, (count(*) FILTER (WHERE op = 'enqueue') - 1)::bigint AS attempts,
       coalesce(max(op) FILTER (WHERE op <> 'enqueue'), 'pending') AS status FROM n GROUP BY entity_id, task HAVING count_if(op = 'enqueue') > 0""",
)
def dedup_tasks(spark, sf):
    return T.dedup_tasks(task_log(table(spark, sf, "events")), ["entity_id"])


@query(
    "next_attempts",
    """SELECT event_id AS task_id, a + 1 AS attempts, CASE WHEN a + 1 < 8 THEN 'pending' ELSE 'failed' END AS status,
       CASE WHEN a + 1 < 8 THEN least(power(2, a + 1), 60)::bigint ELSE -1 END AS retry_in FROM (SELECT event_id, floor(value)::bigint % 9 AS a FROM events)""",
)
def next_attempts(spark, sf):
    tasks = table(spark, sf, "events").select(
        F.col("event_id").alias("task_id"), (F.floor("value") % 9).alias("attempts"), F.col("ts").alias("last_attempt_at")
    )
    return T.next_attempts(tasks, 8).select("task_id", "attempts", "status", F.coalesce("retry_in", F.lit(-1).cast("long")).alias("retry_in"))


STATE = "CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING' ELSE 'PENDING' END"


def state_log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.expr(STATE).alias("status"), "value"
    )


@query("compact_task_log", f"SELECT * FROM (SELECT user_id AS task_id, max(event_id) AS seq, max_by({STATE}, event_id) AS status, max_by(value, event_id) AS value FROM events GROUP BY 1) WHERE status <> 'DONE'")
def compact_task_log(spark, sf):
    return T.compact_task_log(state_log(spark, sf))


@query("recover_tasks", f"SELECT task_id, seq, 'pending' AS status FROM (SELECT user_id AS task_id, max(event_id) AS seq, max_by({STATE}, event_id) AS status FROM events GROUP BY 1) WHERE status IN ('PENDING', 'RUNNING')")
def recover_tasks(spark, sf):
    return T.recover_tasks(state_log(spark, sf)).drop("value")


@query(
    "queue_stats",
    f"SELECT user_id, count_if(op = 'enqueue')::bigint AS enqueued, count_if(op = 'done')::bigint AS completed, count_if(op = 'failed')::bigint AS failed, 0::bigint AS recovered, (count_if(op = 'enqueue') - count_if(op <> 'enqueue'))::bigint AS pending FROM (SELECT user_id, {OP} AS op FROM events) GROUP BY 1",
)
def queue_stats(spark, sf):
    return T.queue_stats(table(spark, sf, "events").select("user_id", F.expr(OP).alias("op")), "user_id")


# --- streams -----------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


@query(
    "stream_task_dedup",
    "SELECT user_id AS entity_id, 't' || min_by(event_id, (ts, 't' || event_id)) AS task_id, count(*) - 1 AS attempts FROM events GROUP BY 1",
)
def stream_task_dedup(spark, sf):
    """Every event asks for its user's task, and none ends."""
    tasks = event_stream(spark, sf).select(
        F.col("user_id").alias("entity_id"), "ts", F.concat(F.lit("t"), F.col("event_id")).alias("task_id"), F.lit("enqueue").alias("op")
    )
    return followed(spark, T.dedup_stream(tasks, ["entity_id"])).drop("status")


@query("stream_task_ends", ORACLES["dedup_tasks"])
def stream_task_ends(spark, sf):
    """The whole log with its ends, as the batch form reads it."""
    return followed(spark, T.dedup_stream(task_log(event_stream(spark, sf)), ["entity_id"], "seq"))


@query("stream_task_folds", ORACLES["dedup_tasks"])
def stream_task_folds(spark, sf):
    """The whole log, in batches that pass on a table of pending tasks."""
    out = scratch_path(spark, "folds")
    T.follow_tasks(
        task_log(event_stream(spark, sf)), scratch_path(spark, "folds-state"), scratch_path(spark, "folds-checkpoint"),
        lambda changed, epoch: changed.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), ["entity_id"], "seq",
    )
    return last_told(spark.read.parquet(out))


def followed(spark, changed):
    """The last state of every task of a stream of changes."""
    out = scratch_path(spark, "dedup")

    def each(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query_ = (
        changed.writeStream.outputMode("update").foreachBatch(each)
        .option("checkpointLocation", scratch_path(spark, "dedup-checkpoint")).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return last_told(spark.read.parquet(out))


def last_told(told):
    last = F.max_by(F.struct("attempts", "status"), "epoch").alias("_r")
    return told.groupBy("entity_id", "task_id").agg(last).select("entity_id", "task_id", "_r.*")


@query(
    "stream_sessions",
    """WITH o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS op FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
r AS (SELECT *, sum(op) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o),
s AS (SELECT user_id, event_type, count(*) AS event_count, max(ts) AS last_ts FROM r GROUP BY user_id, event_type, run)
SELECT user_id, event_type, event_count, epoch_us(last_ts) AS last_us FROM s WHERE last_ts + INTERVAL 2 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""",
)
def stream_sessions(spark, sf):
    out = scratch_path(spark, "sessions")
    timed = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = W.coalesce_stream(timed, "user_id", "2 hours", "1 hour")
    q = (
        sessions.select("user_id", "event_type", "event_count", F.unix_micros("last_ts").alias("last_us"))
        .writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "sessions-checkpoint")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_events",
    "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'signup')",
)
def stream_events(spark, sf):
    log = scratch_path(spark, "bus")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    V.publish(events, log)
    out = scratch_path(spark, "seen")

    def each(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    W.run_available(
        V.subscribe(spark, log, "error", "signup", schema="event_id bigint, user_id bigint, event_type string"),
        scratch_path(spark, "bus-checkpoint"), each,
    )
    return spark.read.parquet(out).drop("epoch")


@query("stream_index", f"WITH {CHUNKS_SQL} SELECT entity_id, chunk_index, text FROM chunks")
def stream_index(spark, sf):
    index = scratch_path(spark, "live-index")
    docs = spark.readStream.schema(table(spark, sf, "documents").schema).parquet(f"{sf}/documents*.parquet").select(
        F.col("lang").alias("workspace_id"), F.col("source").alias("collection_id"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id"), F.lit("canonical_md").alias("rep_name"), "text",
    )
    chunk = lambda df: chunk_fixed(df, 500).drop("start_pos")
    V.maintain_index(docs, index, scratch_path(spark, "live-checkpoint"), shards=2, chunk=chunk)
    # A second subscriber that replays everything leaves the index as it is.
    V.maintain_index(docs, index, scratch_path(spark, "live-checkpoint"), shards=2, chunk=chunk)
    return read_chunk_index(spark, index).select("entity_id", "chunk_index", "text")


@query("watch_created", "SELECT doc_id, length(text) AS n FROM documents WHERE octet_length(encode(text)) <= 0.004 * 1024 * 1024")
def watch_created(spark, sf):
    """Documents are dropped as files into a folder and picked up by a stream."""
    folder, out = scratch_path(spark, "drop"), scratch_path(spark, "picked")
    # Dealt over folders, which are listed side by side.
    write_files(table(spark, sf, "documents").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("part"), F.col("doc_id").alias("name"), F.col("text").alias("value")
    ), folder, ["part", "name"], end="\x00", suffix=".txt", last=False)

    def each(batch, epoch):
        few_tasks(batch.select("path", "content")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    W.run_available(W.watch_created(spark, folder, [".TXT"], 0.004), scratch_path(spark, "drop-checkpoint"), each)
    seen = spark.read.parquet(out)
    return seen.select(
        F.regexp_extract("path", "name=(\\d+)", 1).cast("long").alias("doc_id"),
        # An empty document is a file with the separator alone.
        F.length(F.nullif(F.col("content").cast("string"), F.lit("\x00"))).cast("long").alias("n"),
    ).fillna(0, "n")

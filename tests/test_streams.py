"""Streams keep their state from batch to batch."""

import random

from pyspark.sql import functions as F

from tarn.streaming import tasks as T

LOG = "key string, ts long, op string, task_id string"


def test_tasks_after_an_end_are_new(spark, tmp_path):
    log, out, seen = str(tmp_path / "log"), str(tmp_path / "state"), {}

    def each(batch, _):
        seen.update({(r["key"], r["task_id"]): (r["attempts"], r["status"]) for r in batch.collect()})

    batches = [
        [("a", 2, "enqueue", "a2"), ("a", 1, "enqueue", "a1"), ("b", 1, "enqueue", "b1"), ("c", 1, "done", "c0")],
        [("a", 3, "enqueue", "a3"), ("a", 4, "done", "a1"), ("a", 5, "enqueue", "a5"), ("b", 2, "failed", "b1")],
        [("a", 6, "enqueue", "a6"), ("b", 3, "enqueue", "b3"), ("b", 4, "done", "b3"), ("b", 5, "enqueue", "b5")],
    ]
    rows = []
    for batch in batches:
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(log)
        stream = T.dedup_stream(spark.readStream.schema(LOG).parquet(log), ["key"])
        q = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", out)
        q.trigger(availableNow=True).start().awaitTermination()
        rows += batch
    whole = T.dedup_tasks(spark.createDataFrame(rows, LOG), ["key"], ["ts"]).collect()
    assert seen == {(r["key"], r["task_id"]): (r["attempts"], r["status"]) for r in whole}
    assert seen["a", "a1"] == (2, "done") and seen["a", "a5"] == (1, "pending") and seen["b", "b5"] == (0, "pending")


def test_watch_folder_opens_changed_files_only(spark, tmp_path):
    import os

    from tarn.streaming import changes as W

    folder, state = tmp_path / "files", str(tmp_path / "state")
    (folder / "sub dir").mkdir(parents=True)
    names = ["a.md", "b.md", "c.md", "sub dir/d é#%20.md"]

    def put(name, text, at=None):
        (folder / name).write_text(text)
        os.utime(folder / name, (at or 1_700_000_000,) * 2)

    def scan():
        found = W.watch_folder(spark, str(folder), state).collect()
        return {(r["path"].split("/files/")[1], r["event_type"]) for r in found}

    for name in names:
        put(name, f"text of {name}")
    assert scan() == set()  # a silent baseline
    assert spark.read.parquet(state).count() == 4
    # Rewritten with its size and time kept: it would be found if it were opened.
    put("a.md", "TEXT of a.md")
    assert scan() == set()
    put("b.md", "touched later", 1_700_000_100)
    put("c.md", "text of c.md", 1_700_000_100)  # touched, the same content
    put(names[3], "another", 1_600_000_000)  # older than before
    put("e.md", "e", 1_500_000_000)
    assert scan() == {("b.md", "modified"), (names[3], "modified"), ("e.md", "created")}
    assert scan() == set()
    (folder / "b.md").unlink()
    put(names[3], "")
    assert scan() == {("b.md", "deleted"), (names[3], "deleted")}  # empty files are not listed
    # More changed files than are named one by one.
    W.NAMED_FILES, named = 1, W.NAMED_FILES
    try:
        put("c.md", "new", 1_700_000_200)
        put("e.md", "new", 1_400_000_000)
        assert scan() == {("c.md", "modified"), ("e.md", "modified")}
    finally:
        W.NAMED_FILES = named


def test_listing_reads_no_content(spark, tmp_path):
    from tarn.streaming import changes as W

    (tmp_path / "x").write_text("x")
    plan = W.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan
    chosen = W.list_files(spark, str(tmp_path))
    assert W.hash_files(spark, str(tmp_path), chosen.limit(0)).count() == 0


def plain_tasks(rows):
    """Tasks of a log row by row."""
    done, pending = [], {}
    for key, _, op, task in sorted(rows, key=lambda r: (r[1], r[3], r[2] != "enqueue", r[2])):
        if op == "enqueue":
            first, again = pending.get(key, (task, -1))
            pending[key] = (first, again + 1)
        elif op in ("done", "failed") and key in pending:
            done.append((key, *pending.pop(key), op))
    return sorted(done + [(k, *v, "pending") for k, v in pending.items()], key=str)


def test_stretches_compose_with_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rnd = random.Random(7)
    rows = []
    for i in range(1200):
        key = "hot" if i % 2 else rnd.choice(["a", "b", None])
        rows.append((key, i // 3, rnd.choice(["enqueue"] * 4 + ["done", "failed", "recovered"]), f"t{rnd.randint(0, 300)}"))
    rows += rows[:30]  # repeated rows
    rows.sort(key=lambda r: r[1])
    ended, pending = [], None
    edges = [0, 1, 400, 800, 1230]
    try:
        for a, b in zip(edges, edges[1:]):
            # Equal times stay in one stretch, as batches are taken by time.
            part = [r for r in rows if rows[a][1] <= r[1] and (b == 1230 or r[1] < rows[b][1])]
            log = spark.createDataFrame(part, LOG).repartition(5).withColumn("since", F.lit("clash"))
            pending = T.no_tasks(log, ["key"]) if pending is None else pending
            changed, pending = T.fold_tasks(log, pending, ["key"])
            ended += [tuple(r) for r in changed.where("status <> 'pending'").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_tasks(rows)
    assert sorted(ended, key=str) == [w for w in want if w[3] != "pending"]
    left = sorted(((r["key"], r["task_id"], r["attempts"], "pending") for r in pending.collect()), key=str)
    assert left == [w for w in want if w[3] == "pending"]


def test_no_rows_and_expiry(spark):
    log = spark.createDataFrame([("a", 1, "enqueue", "a1"), ("a", 9, "enqueue", "a2"), ("b", 2, "enqueue", "b1")], LOG)
    changed, pending = T.fold_tasks(log, T.no_tasks(log, ["key"]), ["key"], expire_after=F.lit(5))
    assert sorted(tuple(r) for r in changed.collect()) == [("a", "a1", 1, "pending"), ("b", "b1", 0, "expired")]
    none = log.limit(0)
    changed, after = T.fold_tasks(none, pending, ["key"], expire_after=F.lit(5))
    assert changed.count() == 0 and after.collect() == pending.collect()
    later = spark.createDataFrame([("c", 15, "enqueue", "c1"), (None, 15, "enqueue", None)], LOG)
    changed, after = T.fold_tasks(later, after, ["key"], expire_after=F.lit(5))
    assert {(r["key"], r["status"]) for r in changed.collect()} == {("a", "expired"), ("c", "pending"), (None, "pending")}
    assert {r["key"] for r in after.collect()} == {"c", None}


def test_followed_tasks_keep_their_state(spark, tmp_path):
    log, told = str(tmp_path / "log"), []
    for batch in (
        [("a", 1, "enqueue", "a1"), ("b", 1, "enqueue", "b1")],
        [("a", 3, "enqueue", "a3"), ("a", 4, "done", "a1"), ("a", 5, "enqueue", "a5")],
    ):
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(LOG).parquet(log)
        T.follow_tasks(
            stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"),
            lambda changed, epoch: told.extend((epoch, *r) for r in changed.collect()), ["key"],
        )
    assert sorted(told) == [(0, "a", "a1", 0, "pending"), (0, "b", "b1", 0, "pending"), (1, "a", "a1", 1, "done"), (1, "a", "a5", 0, "pending")]


def test_dropped_documents_of_the_largest_size_and_empty_ones_are_picked_up(spark, tmp_path):
    """4,194 bytes are within 0.004 MB: a separator in the file once made it too large."""
    from tarn.checks.streaming import watch_created

    rows = [(1, "x" * 4194), (2, "x" * 4195), (3, ""), (4, "ä" * 2097), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, watch_created(spark, str(tmp_path)).collect())) == [(1, 4194), (3, 0), (4, 2097), (5, 0)]


def test_a_watch_leaves_too_large_files_closed(spark, tmp_path):
    from tarn.operators.entities import filter_files

    (tmp_path / "a.txt").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("name", F.col("path"))
    plan = filter_files(files, [".TXT"], 0.004)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4194)" in plan

"""Files, manifests, logs and the written index."""

import json
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tarn.operators import search as S
from tarn.operators.entities import ENTITY_KEY
from tarn.operators.tables import query_table
from tarn.sources import corpus as R
from tarn.sources import index_table as X


def test_scan(spark, tmp_path):
    for rel in ("ws/col/ent_1/source/original", "ws/col/ent_1/extract/canonical.md", "ws/col/ent_1/extract/extra.txt",
                "ws/col/_tmp/source/original", "ws/col/ent_1/_index/staging/canonical_md.parquet"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    got = {(r["entity_id"], r["rep_type"]) for r in R.scan_corpus(spark, str(tmp_path)).collect()}
    assert got == {("ent_1", "source_original"), ("ent_1", "canonical_md"), ("ent_1", "extra")}


def test_broken_manifests(spark, tmp_path):
    good = {"entity_id": "e", "workspace_id": "w", "collection_id": "c", "version": 2, "labels": ["a"],
            "rep_info": {"canonical_md": {"rep_type": "canonical_md", "status": "stale", "modality": "text"}}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{ not json")
    got = R.read_manifests(spark, str(tmp_path), multi_line=True).collect()
    assert len(got) == 1 and got[0]["rep_info"]["canonical_md"]["status"] == "stale"


def test_broken_log_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(
        '{"entity_id": "e", "version": 1, "timestamp": "2024-01-01T00:00:00Z", "trigger": "ingest"}\n{broken\n'
        '{"entity_id": "e", "version": 2, "timestamp": "2024-01-02T00:00:00Z", "trigger": "update"}\n'
    )
    assert [r["version"] for r in R.read_version_log(spark, str(tmp_path)).collect()] == [1, 2]


def test_snake_case():
    assert [R.snake_case(n) for n in ("Customer Key", "customerName", "A-B", "  x ", "%")] == [
        "customer_key", "customer_name", "a_b", "x", "column"]


def test_index_partition_pruning(spark, tmp_path):
    rows = spark.range(100).select(
        F.lit("w").alias("workspace_id"), F.concat(F.lit("c"), F.col("id") % 4).alias("collection_id"),
        F.concat(F.lit("e"), F.col("id")).alias("entity_id"), F.lit("canonical_md").alias("rep_name"),
        F.lit(0).cast("long").alias("chunk_index"), F.lit("t").alias("text"),
    )
    path = str(tmp_path / "ix")
    X.write_chunk_index(rows, path, shards=4)
    one = X.read_chunk_index(spark, path, workspace="w", collection="c1", entity="e5")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace_id" in plan and "shard" in plan.split("PartitionFilters")[1][:300]
    again = rows.filter("collection_id = 'c2'").withColumn("text", F.lit("new"))
    assert X.sync_index(spark, path, again) == 25
    assert X.sync_index(spark, path, again) == 25
    counts = {r["text"]: r["count"] for r in X.read_chunk_index(spark, path).groupBy("text").count().collect()}
    assert counts == {"t": 75, "new": 25}
    with pytest.raises(ValueError, match="4 shards, not 8"):
        X.write_chunk_index(rows, path, shards=8)


def chunk_frame(spark, *rows):
    names = "workspace_id string, collection_id string, entity_id string, rep_name string, chunk_index long, text string, version int"
    return spark.createDataFrame([("w", "c d", e, "canonical_md", i, t, v) for e, i, t, v in rows], names)


def test_sync_takes_the_latest_version_and_empties(spark, tmp_path):
    path = str(tmp_path / "ix")
    X.write_chunk_index(chunk_frame(spark, ("a", 0, "old", 1), ("b", 0, "b", 1)).drop("version"), path, shards=8)
    batch = chunk_frame(spark, ("a", 0, "v1", 1), ("a", 1, "v1", 1), ("a", 0, "v2", 2), ("a", 0, "v2", 2), ("a", 3, "?", None))
    for _ in range(2):
        assert X.sync_index(spark, path, batch, order="version") == 1
        got = {(r["entity_id"], r["text"]) for r in X.read_chunk_index(spark, path).collect()}
        assert got == {("a", "v2"), ("b", "b")}
    # b has no chunk any more: its partition goes, although nothing is written into it.
    touched = chunk_frame(spark, ("b", 0, "", 2))
    assert X.sync_index(spark, path, batch.limit(0).drop("version"), touched=touched) == 0
    assert [r["entity_id"] for r in X.read_chunk_index(spark, path).collect()] == ["a"]


def index_frame(spark, collection, entities, text, per=1):
    rows = [("w ü", collection, f"e{e}", "a=b/c", i, text) for e in entities for i in range(per)]
    return spark.createDataFrame(rows, "workspace_id string, collection_id string, entity_id string, rep_name string, chunk_index long, text string")


def files_of(spark, path):
    return {unquote(f) for f in spark.read.parquet(path).inputFiles()}


def test_sync_writes_its_rows_only(spark, tmp_path):
    path = str(tmp_path / "ix")
    whole = index_frame(spark, "c%1", range(400), "old", 3).unionByName(index_frame(spark, "c2", range(50), "old"))
    X.write_chunk_index(whole, path)
    before = files_of(spark, path)
    assert X.sync_index(spark, path, index_frame(spark, "c%1", range(100), "new")) == 100
    added = files_of(spark, path) - before
    assert before < files_of(spark, path) and spark.read.parquet(*added).count() == 100
    read = lambda: sorted((r["collection_id"], r["text"], r["count"]) for r in X.read_chunk_index(spark, path).groupBy("collection_id", "text").count().collect())
    want = [("c%1", "new", 100), ("c%1", "old", 900), ("c2", "old", 50)]
    assert read() == want
    # Another collection is emptied, and the same entities change once more.
    X.sync_index(spark, path, index_frame(spark, "c%1", range(10), "newer"), touched=index_frame(spark, "c2", range(50), ""))
    want = [("c%1", "new", 90), ("c%1", "newer", 10), ("c%1", "old", 900)]
    assert read() == want
    assert X.compact_index(spark, path) > 0 and read() == want
    assert not any("delta=0/" not in f or "collection_id=c2" in f for f in files_of(spark, path))
    assert X.compact_index(spark, path) == 0


def test_rewritten_partitions_lose_their_deltas(spark, tmp_path):
    path = str(tmp_path / "ix")
    X.write_chunk_index(index_frame(spark, "c1", range(5), "old").unionByName(index_frame(spark, "c2", range(5), "old")), path, shards=1)
    X.sync_index(spark, path, index_frame(spark, "c1", [1], "new").unionByName(index_frame(spark, "c2", [1], "new")))
    X.write_chunk_index(index_frame(spark, "c1", range(3), "again"), path)
    got = sorted((r["collection_id"], r["text"]) for r in X.read_chunk_index(spark, path).collect())
    assert got == [("c1", "again")] * 3 + [("c2", "new")] + [("c2", "old")] * 4


def test_shards_follow_the_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SHARD_ROWS", 100)
    X.write_chunk_index(index_frame(spark, "c1", range(450), "t"), str(tmp_path / "ix"))
    assert X.stored_shards(spark, str(tmp_path / "ix")) == 5
    with pytest.raises(ValueError, match="no index"):
        X.sync_index(spark, str(tmp_path / "none"), index_frame(spark, "c1", [1], "t"))


def test_rebuild_reports_what_it_cannot_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def stage(where, table):
        path = tmp_path / where
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table(table), path) if isinstance(table, dict) else path.write_bytes(table)

    stage("w/c/e1/staging/canonical_md.parquet", {"chunk_index": [0, 1], "text": ["a", "b"], "embedding": [[1.0], [2.0]], "more": [1, 2]})
    stage("w/c/e1/staging/notes.parquet", {"chunk_index": [0], "rep_name": ["other"]})
    stage("w/c/e2/staging/canonical_md.parquet", b"PAR1 cut off")
    stage("w/c/e3/staging/canonical_md.parquet", {"chunk_index": ["x"], "text": ["a"]})
    stage("w/c/e4/staging/canonical_md.parquet", {"chunk_index": [], "text": []})
    stage("w/c/_e5/staging/canonical_md.parquet", {"chunk_index": [0]})
    stage("w/stray.parquet", {"chunk_index": [0]})
    rows, rejected = X.rebuild_index(spark, str(tmp_path))
    got = sorted((r["entity_id"], r["rep_name"], r["chunk_index"], r["text"], r["embedding"]) for r in rows.collect())
    assert got == [("e1", "canonical_md", 0, "a", [1.0]), ("e1", "canonical_md", 1, "b", [2.0]), ("e1", "other", 0, None, None)]
    why = {r["entity_id"]: r["error"] for r in rejected.collect()}
    assert set(why) == {"e2", "e3", ""} and "ArrowInvalid" in why["e2"] and "not below" in why[""]


def test_stream_with_two_versions_in_a_batch(spark, tmp_path):
    from tarn.streaming.events import maintain_index

    source, path = str(tmp_path / "in"), str(tmp_path / "ix")
    chunk_frame(spark, ("a", 0, "v1", 1), ("a", 0, "v2", 2), ("b", 0, "b", 1)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(chunk_frame(spark).schema).parquet(source)
    keep = lambda docs: docs.filter("text != ''")
    for _ in range(2):
        chunk_frame(spark, ("b", 0, "", 3)).write.mode("append").parquet(source)
        maintain_index(stream, path, str(tmp_path / "cp"), chunk=keep, order="version")
        assert [r["text"] for r in X.read_chunk_index(spark, path).collect()] == ["v2"]


def test_assemble_defaults(spark):
    paths = spark.createDataFrame([("w", "c", "e")], ", ".join(f"{c} string" for c in ENTITY_KEY))
    none = spark.createDataFrame([], R.MANIFEST_SCHEMA)
    tags = spark.createDataFrame([], ", ".join(f"{c} string" for c in ENTITY_KEY) + ", tags map<string,string>")
    r = R.assemble_entities(paths, none, tags).first()
    assert (r["entity_type"], r["version"], r["status"], r["name"], r["labels"]) == ("document", 1, "enabled", "e", [])


def test_only_reading_sql(spark):
    with pytest.raises(ValueError):
        query_table(spark.range(1), "DROP TABLE t")
    with pytest.raises(ValueError):
        query_table(spark.range(1), "WITH a AS (SELECT 1 AS id) INSERT INTO t SELECT * FROM a")
    assert query_table(spark.range(3), "SELECT id FROM t ORDER BY id DESC; ").first()["id"] == 2
    assert query_table(spark.range(3), "WITH x AS (SELECT * FROM t) SELECT count(*) AS n FROM x").first()["n"] == 3


def test_scratch_tables_are_removed(spark):
    from pathlib import Path

    from tarn.session import checkpoint_dir, durable, scratch

    def steps():
        return {p.name for p in Path(checkpoint_dir(spark)).glob("tarn-step-*")}

    before = steps()
    with scratch(spark):
        assert durable(spark.range(5)).count() == 5
        assert len(steps() - before) == 1
    assert steps() == before
    kept = durable(spark.range(3).filter("id > 9"))
    assert kept.count() == 0 and kept.columns == ["id"] and len(steps() - before) == 1


def test_changes_are_kept_until_handled(spark, tmp_path):
    from tarn.streaming.changes import watch_once

    listing = spark.createDataFrame([("/a", "h", 1)], "path string, content_hash string, size long")
    state = str(tmp_path / "snapshot")
    watch_once(spark, listing.withColumn("content_hash", F.lit("g")), state)

    def fail(_):
        raise RuntimeError("not handled")

    with pytest.raises(RuntimeError):
        watch_once(spark, listing, state, fail)
    assert watch_once(spark, listing, state, lambda changes: None).count() == 1
    assert watch_once(spark, listing, state).count() == 0


def test_written_postings_know_their_buckets(spark, tmp_path):
    def words(*texts):
        rows = [("w", "c", f"e{i}", "canonical_md", 0, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            rows, "workspace_id string, collection_id string, entity_id string, rep_name string, chunk_index long, text string")

    path, asked = str(tmp_path / "postings"), spark.createDataFrame([(i, f"term{i}") for i in range(30)], "query_id long, text string")
    for buckets in (64, 5):
        S.write_postings(words(*(f"term{i} common" for i in range(30))), path, buckets)
        assert S.search_lexical_written(spark, path, asked).select("query_id").distinct().count() == 30
        with pytest.raises(ValueError, match=f"{buckets} buckets, not 7"):
            S.search_lexical_written(spark, path, asked, buckets=7)
    S.write_postings(words("term1"), path, 64)
    assert [r["query_id"] for r in S.search_lexical_written(spark, path, asked).collect()] == [1]


def test_files_are_written_by_the_tasks_as_spark_would(spark, tmp_path):
    """Escaped and missing names, rows that share a place, null and empty texts: the same rows as over
    Spark's partitioned writer, and no second file, folder or checksum for a file."""
    rows = spark.createDataFrame(
        [("w", "a/b c", "e1", "one"), ("w", "a/b c", "e2", None), (None, "x=1%", "e3", ""), ("", "c", "e4", "twice"),
         ("", "c", "e4", "twice"), ("w", "d", None, "nowhere"), ("ü", "_h", "e5", "ä")],
        "workspace string, collection string, entity string, value string",
    ).select("workspace", "collection", "entity", F.lit("source").alias("stage"), F.lit("original").alias("file"), "value")
    where = ["workspace", "collection", "entity", "stage", "file"]
    R.write_files(rows, str(tmp_path / "own"), where, end="\x00")
    rows.repartition(*where).write.partitionBy(*where).option("lineSep", "\x00").text(str(tmp_path / "spark"))
    own, other = (
        sorted(map(tuple, R.scan_corpus(spark, str(tmp_path / x)).select(*ENTITY_KEY, "relpath", "size", F.hex("content")).collect()))
        for x in ("own", "spark")
    )
    assert own == other and len(own) == 5
    files = [p for p in (tmp_path / "own").rglob("*") if p.is_file()]
    assert len(files) == 6 and not [p for p in files if p.name.startswith(".")]


def test_hidden_collections_and_empty_corpora(spark, tmp_path):
    for rel in ("ws/_hidden/e/source/original", "ws/.dot/e/source/original", "_ws/col/e/source/original", "ws/c/e/source/original"):
        (tmp_path / "full" / rel).parent.mkdir(parents=True)
        (tmp_path / "full" / rel).write_text("x")
    (tmp_path / "none").mkdir()
    assert [r["collection_id"] for r in R.scan_corpus(spark, str(tmp_path / "full")).collect()] == ["c"]
    assert R.scan_corpus(spark, str(tmp_path / "none")).count() == 0


def test_many_small_files_share_tasks(spark, tmp_path):
    rows = spark.range(2000).select(F.lit("w").alias("w"), F.lit("c").alias("c"), F.col("id").alias("e"), F.lit("s").alias("s"),
                                    F.lit("o").alias("o"), F.lit("x").alias("value"))
    R.write_files(rows, str(tmp_path / "c"), ["w", "c", "e", "s", "o"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = R.scan_corpus(spark, str(tmp_path / "c"))
        assert found.rdd.getNumPartitions() <= 64 and found.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

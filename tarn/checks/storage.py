"""Source, sink and virtual file tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.checks.base import query, table
from tarn.checks.entities import reps_of, with_status
from tarn.operators import vfs as V
from tarn.operators.chunking import chunk_fixed
from tarn.operators.text_index import TextIndex
from tarn.session import scratch_path
from tarn.sources import corpus as R
from tarn.sources import index_table as X


@query(
    "scan_corpus",
    """SELECT lang AS workspace_id, source AS collection_id, 'doc_' || doc_id AS entity_id, 'source/original' AS relpath, 'source_original' AS rep_type,
       octet_length(encode(text)) AS size, substr(sha256(text), 1, 16) AS content_hash FROM documents""",
)
def scan_corpus(spark, sf):
    """Documents written as a corpus, one file each, and read back."""
    root = scratch_path(spark, "corpus")
    where = ["workspace", "collection", "entity", "stage", "file"]
    rows = table(spark, sf, "documents").select(
        F.col("lang").alias("workspace"), F.col("source").alias("collection"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity"), F.lit("source").alias("stage"),
        F.lit("original").alias("file"), F.col("text").alias("value"),
    )
    R.write_files(rows, root, where, end="\x00")
    files = R.scan_corpus(spark, root)
    # Every row is ended by the separator.
    body = F.expr("substring(content, 1, length(content) - 1)")
    return files.select(
        *R.ENTITY_KEY, "relpath", "rep_type", (F.col("size") - 1).alias("size"), F.sha2(body, 256).substr(1, 16).alias("content_hash")
    )


@query(
    "migrate",
    """SELECT page_id, 'canonical_md' AS rep_name, 2::bigint AS version, 1::bigint AS first_run, 0::bigint AS second_run FROM pages""",
)
def migrate(spark, sf):
    once, version, first = X.migrate(table(spark, sf, "pages").select("page_id"), 1)
    twice, version, second = X.migrate(once, version)
    return twice.select(
        "page_id", "rep_name", F.lit(version).cast("long").alias("version"),
        F.lit(first).cast("long").alias("first_run"), F.lit(second).cast("long").alias("second_run"),
    )


KINDS = "CASE event_type WHEN 'click' THEN 'canonical_md' WHEN 'error' THEN 'ocr_text' WHEN 'purchase' THEN 'table_json' WHEN 'signup' THEN 'page_image' ELSE 'rep_pdf' END"


@query(
    "rep_dims",
    f"""WITH d(rep_type, stage, relpath, depth, modality) AS (VALUES ('canonical_md', 'extract', 'extract/canonical.md', 1, 'text'),
  ('ocr_text', 'recognize', 'recognize/ocr.md', 2, 'text'), ('table_json', 'compile', 'compile/table.json', 3, 'table'),
  ('page_image', 'extract', 'extract/page_image', 1, 'image'), ('rep_pdf', 'extract', 'extract/rep_pdf', 1, 'text'))
SELECT event_id, d.* FROM events JOIN d ON d.rep_type = {KINDS}""",
)
def rep_dims(spark, sf):
    return R.with_rep_dims(table(spark, sf, "events").select("event_id", F.expr(KINDS).alias("rep_type")))


@query(
    "rep_type_of_path",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'extract/canonical.md' WHEN 'error' THEN 'recognize/ocr.md' ELSE 'extract/' || event_type || '.txt' END AS relpath,
       CASE event_type WHEN 'click' THEN 'canonical_md' WHEN 'error' THEN 'ocr_text' ELSE event_type END AS rep_type FROM events""",
)
def rep_type_of_path(spark, sf):
    path = "CASE event_type WHEN 'click' THEN 'extract/canonical.md' WHEN 'error' THEN 'recognize/ocr.md' ELSE concat('extract/', event_type, '.txt') END"
    return R.with_rep_type(table(spark, sf, "events").select("event_id", F.expr(path).alias("relpath")))


@query(
    "assemble_entities",
    """SELECT 'doc_' || d.doc_id AS entity_id, CASE WHEN quality = 1 THEN d.doc_id || '.md' WHEN quality = 0 THEN 'tagged' ELSE 'doc_' || d.doc_id END AS name,
       CASE WHEN quality = 1 THEN 3 WHEN quality = 0 THEN 2 ELSE 1 END AS version,
       CASE WHEN quality = 1 THEN 'hidden' ELSE 'enabled' END AS status,
       CASE WHEN quality = 1 THEN 'm1|m2' WHEN quality = 0 THEN 'a|b' ELSE '' END AS labels,
       CASE WHEN quality = 1 THEN '' ELSE 'local://' || lang || '/' || source || '/doc_' || d.doc_id || '/source_original' END AS source_uri
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def assemble_entities(spark, sf):
    base = with_status(spark, sf).drop("status", "labels").join(table(spark, sf, "labels"), "doc_id", "left")
    manifests = base.filter("quality = 1").select(
        *R.ENTITY_KEY, F.concat(F.col("doc_id"), F.lit(".md")).alias("name"), F.lit(3).alias("version"),
        F.lit("hidden").alias("status"), F.array(F.lit("m1"), F.lit("m2")).alias("labels"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "entity_type", "source_type", "source_uri", "content_hash", "model_version", "created_at", "updated_at")],
    )
    tags = base.filter("quality = 0").select(
        *R.ENTITY_KEY,
        F.create_map(F.lit("name"), F.lit("tagged"), F.lit("version"), F.lit("2"), F.lit("labels"), F.lit("a,b")).alias("tags"),
    )
    return R.assemble_entities(base, manifests, tags).select(
        "entity_id", "name", "version", "status", F.array_join("labels", "|").alias("labels"), "source_uri"
    )


@query(
    "entity_meta",
    """SELECT 'doc_' || d.doc_id AS entity_id, CASE WHEN coalesce(quality, 1) = 1 THEN 'canonical_md,source_original' ELSE 'source_original' END AS reps,
       CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END::bigint AS stale, lang AS label_tag, '1' AS version_tag
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def entity_meta(spark, sf):
    base = with_status(spark, sf)
    reps = reps_of(spark, sf).join(base.select("entity_id", "workspace_id", "collection_id"), "entity_id").withColumn(
        "modality", F.lit("text")
    )
    entities = base.select(*R.ENTITY_KEY, "status", "version", "content_hash", "labels").withColumn(
        "entity_type", F.lit("document")
    ).withColumn("name", F.col("entity_id")).withColumn("model_version", F.lit(""))
    meta = R.entity_meta(entities, reps)
    tags = R.tags_from_manifest(meta).select("entity_id", "tags")
    return meta.join(tags, "entity_id").select(
        "entity_id",
        F.array_join(F.array_sort(F.map_keys("rep_info")), ",").alias("reps"),
        F.size(F.filter(F.map_values("rep_info"), lambda r: r["status"] == "stale")).cast("long").alias("stale"),
        F.col("tags")["labels"].alias("label_tag"),
        F.col("tags")["version"].alias("version_tag"),
    )


@query(
    "manifest_round_trip",
    """SELECT 'doc_' || doc_id AS entity_id, lang AS workspace_id, source AS collection_id, substr(sha256(text), 1, 16) AS content_hash,
       lang AS labels, 'active' AS source_status FROM documents""",
)
def manifest_round_trip(spark, sf):
    base = with_status(spark, sf)
    reps = base.select(*R.ENTITY_KEY, F.lit("source_original").alias("rep_type"), F.lit("active").alias("status"), F.lit("text").alias("modality"))
    meta = R.entity_meta(base.drop("text", "doc_id"), reps)
    path = scratch_path(spark, "manifests")
    R.write_entity_meta(meta, path)
    return R.read_manifests(spark, path).select(
        *R.ENTITY_KEY, "content_hash", F.array_join("labels", ",").alias("labels"),
        F.col("rep_info")["source_original"]["status"].alias("source_status"),
    )


@query(
    "rep_records",
    """SELECT page_id, 'canonical_md' AS rep_type, 'passthru' AS transform, 'pipeline_a' AS pipeline_id, '1.0.0' AS pipeline_version,
       '' AS model_version, substr(sha256(html), 1, 16) AS input_content_hash, substr(sha256(regexp_replace(html, '<[^>]*>', '', 'g')), 1, 16) AS content_hash,
       'active' AS status, 'text' AS modality FROM pages""",
)
def rep_records(spark, sf):
    outputs = table(spark, sf, "pages").select(
        "page_id", F.lit("canonical_md").alias("rep_type"), F.lit("passthru").alias("transform"),
        F.lit("pipeline_a").alias("pipeline_id"), F.lit("1.0.0").alias("pipeline_version"),
        F.lit("").alias("model_version"), F.lit("md").alias("output_format"),
        F.col("html").alias("input_content"), F.regexp_replace("html", "<[^>]*>", "").alias("content"),
    )
    return R.rep_records(outputs)


@query(
    "version_log",
    """SELECT 'u' || user_id AS entity_id, count(*) AS n, sum(event_id)::bigint AS version_sum, min(event_type) AS first_trigger FROM events GROUP BY user_id""",
)
def version_log(spark, sf):
    path = scratch_path(spark, "versions")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("entity_id"), F.col("event_id").cast("int").alias("version"),
        F.sha2("props", 256).substr(1, 16).alias("content_hash"), F.col("ts").alias("timestamp"), F.col("event_type").alias("trigger"),
    )
    R.append_version_log(rows, path)
    return R.read_version_log(spark, path).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("version").alias("version_sum"), F.min("trigger").alias("first_trigger")
    )


@query(
    "ingest_csv",
    """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row_id, c_custkey::bigint AS customer_key, c_name AS customer_name,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS market_segment, c_acctbal AS account_balance FROM customer""",
)
def ingest_csv(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("customerName"),
        F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END").alias("Market-Segment"),
        F.col("c_acctbal").alias("ACCOUNT_BALANCE"),
    ).write.option("header", "true").csv(path)
    rows = R.ingest_table(spark, path, "csv", order=["Customer Key"])
    return rows.withColumn("customer_key", F.col("customer_key").cast("long")).withColumn(
        "market_segment", F.coalesce("market_segment", F.lit(""))
    )


@query(
    "ingest_json",
    """SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS _row_id, s_suppkey::bigint AS supp_key, s_name AS supp_name, s_acctbal AS balance FROM supplier""",
)
def ingest_json(spark, sf):
    path = scratch_path(spark, "json")
    table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("suppKey"), F.col("s_name").alias("suppName"), F.col("s_acctbal").alias("Balance")
    ).write.json(path)
    return R.ingest_table(spark, path, "json", order=["suppKey"])


# --- the index table ---------------------------------------------------------------


def chunk_rows(spark, sf):
    """Documents in pieces of 500 characters as index rows."""
    base = with_status(spark, sf).select(*R.ENTITY_KEY, F.lit("canonical_md").alias("rep_name"), "doc_id", "text")
    return chunk_fixed(base, 500).drop("start_pos")


CHUNKS_SQL = """chunks AS (
  SELECT doc_id, lang AS workspace_id, source AS collection_id, 'doc_' || doc_id AS entity_id, i AS chunk_index, substr(text, (i * 500 + 1)::int, 500) AS text
  FROM (SELECT *, unnest(generate_series(0, greatest(ceil((length(text) - 500) / 500.0), 0)::bigint)) AS i FROM documents))"""


@query(
    "index_round_trip",
    f"WITH {CHUNKS_SQL} SELECT workspace_id, collection_id, entity_id, chunk_index, text FROM chunks WHERE workspace_id = 'en'",
)
def index_round_trip(spark, sf):
    path = scratch_path(spark, "index")
    X.write_chunk_index(chunk_rows(spark, sf).drop("doc_id"), path, shards=4)
    return X.read_chunk_index(spark, path, workspace="en", rep="canonical_md").select(
        *R.ENTITY_KEY, "chunk_index", "text"
    )


SYNC_SQL = f"""{CHUNKS_SQL},
good AS (SELECT doc_id FROM labels WHERE quality = 1),
synced AS (
  SELECT entity_id, 'canonical_md' AS rep_name, chunk_index, text FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM good)
  UNION ALL SELECT entity_id, 'canonical_md', 0, 'version 2 of ' || entity_id FROM chunks WHERE chunk_index = 0 AND doc_id IN (SELECT doc_id FROM good)
  UNION ALL SELECT entity_id, 'canonical_md', 1, 'extra chunk' FROM chunks WHERE chunk_index = 0 AND doc_id IN (SELECT doc_id FROM good))"""


def staged_rows(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    base = with_status(spark, sf).join(good, "doc_id", "left_semi").select(*R.ENTITY_KEY, F.lit("canonical_md").alias("rep_name"))
    texts = F.array(F.concat(F.lit("version 2 of "), "entity_id"), F.lit("extra chunk"))
    return base.select("*", F.posexplode(texts).alias("chunk_index", "text")).withColumn(
        "chunk_index", F.col("chunk_index").cast("long")
    )


@query("sync_index", f"WITH {SYNC_SQL} SELECT * FROM synced")
def sync_index(spark, sf):
    return X.replace_reps(chunk_rows(spark, sf).drop("doc_id"), staged_rows(spark, sf)).select(
        "entity_id", "rep_name", "chunk_index", "text"
    )


@query("sync_written_index", f"WITH {SYNC_SQL} SELECT * FROM synced")
def sync_written_index(spark, sf):
    path = scratch_path(spark, "index")
    X.write_chunk_index(chunk_rows(spark, sf).drop("doc_id"), path, shards=4)
    # The batch also holds an older version of every document, which must not win.
    staged = staged_rows(spark, sf).withColumn("version", F.lit(2))
    older = staged.withColumn("version", F.lit(1)).withColumn("text", F.lit("version 1"))
    X.sync_index(spark, path, older.union(staged), order="version")
    return X.read_chunk_index(spark, path).select("entity_id", "rep_name", "chunk_index", "text")


@query("compact_index", f"WITH {SYNC_SQL} SELECT * FROM synced")
def compact_index(spark, sf):
    """The same after two syncs and a compaction: the base alone."""
    path = scratch_path(spark, "index")
    X.write_chunk_index(chunk_rows(spark, sf).drop("doc_id"), path, shards=4)
    staged = staged_rows(spark, sf)
    X.sync_index(spark, path, staged.withColumn("text", F.lit("version 1")))
    X.sync_index(spark, path, staged)
    X.compact_index(spark, path)
    return spark.read.parquet(path).where("delta = 0").select("entity_id", "rep_name", "chunk_index", "text")


DAMAGED = "doc_id % 50 = 7"


@query(
    "rebuild_index",
    f"""WITH {CHUNKS_SQL},
staged AS (SELECT workspace_id, collection_id, doc_id, chunk_index, r AS rep_name FROM chunks, (SELECT unnest(['canonical_md', 'notes']) AS r))
SELECT workspace_id, collection_id, rep_name, count(*) FILTER (NOT bad) AS chunks, count(DISTINCT doc_id) FILTER (NOT bad) AS entities,
       count(DISTINCT doc_id) FILTER (bad) AS rejected
FROM (SELECT *, {DAMAGED} AND rep_name = 'notes' AS bad FROM staged) GROUP BY ALL""",
)
def rebuild_index(spark, sf):
    """Two staged files for every document, some of them damaged."""
    root = scratch_path(spark, "staging")
    staged = chunk_rows(spark, sf).withColumn("bad", F.expr(DAMAGED)).select(
        "workspace_id", "collection_id", "entity_id", "chunk_index", "text", "bad", F.explode(F.array(F.lit("canonical_md"), F.lit("notes"))).alias("rep")
    )

    def write(group):
        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq

        first = group.iloc[0]
        fs, base = pa.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        folder = f"{base}/{first['workspace_id']}/{first['collection_id']}/{first['entity_id']}/staging"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{first['rep']}.parquet") as out:
            if first["bad"] and first["rep"] == "notes":
                out.write(b"PAR1 cut off")
            else:
                pq.write_table(pa.table({"chunk_index": group["chunk_index"].tolist(), "text": group["text"].tolist()}), out)
        return group[["entity_id"]].head(1)

    # The chunks of a document are one group; the files are there when all of them are written.
    staged.groupBy("workspace_id", "collection_id", "entity_id", "rep").applyInPandas(write, "entity_id string").count()
    rows, rejected = X.rebuild_index(spark, root)
    key = ["workspace_id", "collection_id", "rep_name"]
    good = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("entity_id").alias("entities"))
    bad = rejected.withColumn("rep_name", F.regexp_extract("file", "([^/]+)\\.parquet$", 1)).groupBy(*key).agg(F.count(F.lit(1)).alias("rejected"))
    return good.join(bad, key, "left").withColumn("rejected", F.coalesce("rejected", F.lit(0).cast("long")))


@query("indexed_entities", f"WITH {CHUNKS_SQL} SELECT DISTINCT workspace_id, collection_id, entity_id FROM chunks")
def indexed_entities(spark, sf):
    return X.indexed_entities(chunk_rows(spark, sf))


@query("indexed_reps", f"WITH {CHUNKS_SQL} SELECT DISTINCT workspace_id, collection_id, entity_id, 'canonical_md' AS rep_name FROM chunks")
def indexed_reps(spark, sf):
    return X.indexed_reps(chunk_rows(spark, sf))


@query(
    "delete_chunks",
    f"WITH {CHUNKS_SQL} SELECT entity_id, chunk_index FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_chunks(spark, sf):
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id"))
    return X.delete_chunks(chunk_rows(spark, sf), toxic).select("entity_id", "chunk_index")


@query(
    "align_schema",
    """SELECT page_id::varchar AS entity_id, 'canonical_md' AS rep_name, length(html) AS chunk_index, url AS text, '' AS missing FROM pages""",
)
def align_schema(spark, sf):
    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("entity_id"), F.length("html").cast("string").alias("chunk_index"), F.col("url").alias("text")
    )
    aligned, _, _ = X.migrate(X.align_schema(rows, "entity_id string, chunk_index bigint, text string, metadata string"), 1)
    return aligned.select("entity_id", "rep_name", "chunk_index", "text", F.coalesce("metadata", F.lit("")).alias("missing"))


@query(
    "conforming_vectors",
    "SELECT vec_id, label FROM embeddings WHERE label >= 5",
)
def conforming_vectors(spark, sf):
    from tarn.operators.search import conforming_vectors as conforming

    mixed = table(spark, sf, "embeddings").withColumn(
        "embedding", F.when(F.col("label") >= 5, F.col("embedding")).otherwise(F.array().cast("array<float>"))
    )
    return conforming(mixed, 64).select("vec_id", "label")


# --- virtual files -------------------------------------------------------------------


def tree_parts(spark, sf, heavy=False):
    """Entities named ``{source}-{quality}.md`` within their language: names repeat."""
    base = with_status(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    entities = base.select(
        F.lit("all").alias("workspace_id"), F.col("workspace_id").alias("collection_id"), "entity_id",
        F.lit("document").alias("entity_type"), F.when(F.col("quality") == 0, F.concat("collection_id", F.lit(".md")))
        .otherwise(F.concat(F.col("doc_id"), F.lit(".md"))).alias("name"),
        "status", "content_hash", "version", "labels",
    )
    reps = reps_of(spark, sf, heavy).join(base.select("entity_id", F.col("workspace_id").alias("collection_id")), "entity_id").select(
        F.lit("all").alias("workspace_id"), "collection_id", "entity_id", "rep_type", F.length("text").cast("long").alias("size"),
        F.col("text").alias("content"),
    )
    return entities, reps


TREE_SQL = """named AS (
  SELECT d.doc_id, 'doc_' || d.doc_id AS entity_id, lang AS collection_id, text,
         '/' || CASE WHEN quality = 0 THEN source ELSE d.doc_id::varchar END || '.md' AS dir,
         coalesce(quality, 1) = 1 AS canon FROM documents d LEFT JOIN labels l USING (doc_id)),
entries AS (
  SELECT collection_id, dir AS path, 'dir' AS type, entity_id, '' AS rep_type, 0 AS size, NULL AS text FROM named
  UNION ALL SELECT collection_id, dir || '/original', 'file', entity_id, 'source_original', length(text), text FROM named
  UNION ALL SELECT collection_id, dir || '/canonical.md', 'file', entity_id, 'canonical_md', length(text), text FROM named WHERE canon),
tree AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY collection_id, path ORDER BY entity_id DESC) = 1)"""
ENTRY = ["collection_id", "path", "type", "entity_id", "size"]


@query("vfs_tree", f"WITH {TREE_SQL} SELECT collection_id, path, type, entity_id, rep_type, size FROM tree")
def vfs_tree(spark, sf):
    return V.vfs_tree(*tree_parts(spark, sf)).select(*ENTRY, F.coalesce("rep_type", F.lit("")).alias("rep_type"))


@query("vfs_ls_root", f"WITH {TREE_SQL} SELECT collection_id, substr(path, 2) AS entry, entity_id FROM tree WHERE type = 'dir'")
def vfs_ls_root(spark, sf):
    return V.vfs_ls(V.vfs_tree(*tree_parts(spark, sf)), "/").select("collection_id", "entry", "entity_id")


@query("vfs_ls_dir", f"WITH {TREE_SQL} SELECT collection_id, substr(path, 10) AS entry, entity_id, size FROM tree WHERE starts_with(path, '/src3.md/')")
def vfs_ls_dir(spark, sf):
    return V.vfs_ls(V.vfs_tree(*tree_parts(spark, sf)), "/src3.md/").select("collection_id", "entry", "entity_id", "size")


def _paths(spark, sf):
    return table(spark, sf, "labels").select(F.concat(F.lit("/"), F.col("doc_id"), F.lit(".md/original/")).alias("path"))


@query("vfs_stat", f"WITH {TREE_SQL} SELECT collection_id, path, type, entity_id, size FROM tree WHERE path IN (SELECT '/' || doc_id || '.md/original' FROM labels)")
def vfs_stat(spark, sf):
    return V.vfs_stat(V.vfs_tree(*tree_parts(spark, sf)), _paths(spark, sf)).select(*ENTRY)


@query("vfs_read", f"WITH {TREE_SQL} SELECT collection_id, path, entity_id, rep_type, text AS content FROM tree WHERE path IN (SELECT '/' || doc_id || '.md/original' FROM labels)")
def vfs_read(spark, sf):
    entities, reps = tree_parts(spark, sf)
    return V.vfs_read(V.vfs_tree(entities, reps), reps, _paths(spark, sf)).drop("workspace_id")


@query("vfs_glob", f"WITH {TREE_SQL} SELECT collection_id, path, type, entity_id, size FROM tree WHERE regexp_full_match(path, '/[1-3].*md')")
def vfs_glob(spark, sf):
    return V.vfs_glob(V.vfs_tree(*tree_parts(spark, sf)), "/[1-3]*md").select(*ENTRY)


GREP_SQL = f"""WITH {TREE_SQL},
lines AS (
  SELECT collection_id, path, entity_id, rep_type, unnest(generate_series(1, len(ls))) AS line_number, unnest(ls) AS line_text
  FROM (SELECT *, string_split(rtrim(text, chr(10)), chr(10)) AS ls FROM tree WHERE type = 'file')),
ctx AS (
  SELECT *, coalesce(string_agg(line_text, '¦') OVER (PARTITION BY collection_id, path ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(line_text, '¦') OVER (PARTITION BY collection_id, path ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after
  FROM lines)
SELECT collection_id, path AS file_path, line_number, line_text, before, after, entity_id, rep_type FROM ctx
WHERE regexp_matches(line_text, 'th[ei]s? (in|on)', 'i') ORDER BY collection_id, path, line_number LIMIT 500"""


def _grep_lines(found):
    return found.select(
        "collection_id", "file_path", "line_number", "line_text", "entity_id", "rep_type",
        F.array_join("context_before", "¦").alias("before"), F.array_join("context_after", "¦").alias("after"),
    )


@query("vfs_grep", GREP_SQL)
def vfs_grep(spark, sf):
    entities, reps = tree_parts(spark, sf, heavy=True)
    path = scratch_path(spark, "grep")
    V.write_grep_index(reps, path)
    return _grep_lines(V.vfs_grep(V.vfs_tree(entities, reps), TextIndex(spark, path), "th[ei]s? (in|on)", limit=500))


@query("grep_scan", GREP_SQL)
def grep_scan(spark, sf):
    """The same without an index: every line is tested."""
    entities, reps = tree_parts(spark, sf, heavy=True)
    return _grep_lines(V.vfs_grep(V.vfs_tree(entities, reps), reps, "th[ei]s? (in|on)", limit=500))

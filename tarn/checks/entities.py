"""Entity queries: content ids, routing, checks, updates, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.checks.base import ENT_SQL, files, located_files, query, table, texts
from tarn.functions.located import located
from tarn.operators import entities as E
from tarn.schema import FORMAT_ENTITY_TYPE, FORMAT_EXTENSIONS, UNFORMATTED_DOCUMENTS, ext_routes



def now():
    """The clock value every query here is given."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


ROUTES_SQL = "routes(ext, format, entity_type) AS (VALUES " + ", ".join(
    [
        f"('{ext}', '{fmt}', '{FORMAT_ENTITY_TYPE[fmt]}')"
        for fmt, exts in FORMAT_EXTENSIONS.items()
        for ext in exts
    ]
    + [f"('{ext}', NULL, 'document')" for ext in UNFORMATTED_DOCUMENTS]
) + ")"


def entities(spark, sf):
    """Documents as entities, copies collapsed."""
    rows = E.new_entities(files(spark, sf), now())
    return E.dedup_by_content(rows, "doc_id")


@query("content_ids", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, 'ent_' || substr(sha256(text), 1, 16) AS entity_id FROM documents")
def content_ids(spark, sf):
    return E.with_content_id(files(spark, sf)).select("doc_id", "content_hash", "entity_id")


@query("content_dedup", f"WITH {ENT_SQL} SELECT workspace_id, collection_id, entity_id, content_hash, doc_id, name FROM ent")
def content_dedup(spark, sf):
    rows = E.with_content_id(files(spark, sf)).drop("content")
    return E.dedup_by_content(rows, "doc_id")


@query("content_dedup_texts", f"WITH {ENT_SQL} SELECT entity_id, workspace_id, collection_id, ent.doc_id, sha256(text) AS full_hash FROM ent JOIN documents USING (doc_id)")
def content_dedup_texts(spark, sf):
    """Contents of the last uploads, read again by their places."""
    rows = E.dedup_by_content(E.with_content_id(located_files(spark, sf)), "doc_id")
    return rows.select("entity_id", "workspace_id", "collection_id", "doc_id", F.sha2("content", 256).alias("full_hash"))


@query(
    "new_entities",
    f"""WITH {ENT_SQL}
SELECT workspace_id, collection_id, entity_id, name, 'document' AS entity_type, 'oss' AS source_type, 1 AS version,
       workspace_id || '/' || collection_id || '/' || entity_id || '/source/original' AS source_uri,
       'enabled' AS status, len([]) AS n_labels, '2024-02-01' AS created_on FROM ent""",
)
def new_entities(spark, sf):
    return entities(spark, sf).select(
        "workspace_id", "collection_id", "entity_id", "name", "entity_type", "source_type", "version",
        "source_uri", "status", F.size("labels").cast("long").alias("n_labels"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
    )


@query(
    "route_files",
    rf"""WITH {ROUTES_SQL},
named AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages),
exts AS (SELECT *, regexp_extract(lower(name), '(\.[^.]*)$', 1) AS ext FROM named)
SELECT e.page_id, e.name, e.ext, coalesce(r.format, nullif(substr(e.ext, 2), '')) AS format, r.entity_type
FROM exts e LEFT JOIN routes r ON r.ext = e.ext""",
)
def route_files(spark, sf):
    named = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1).alias("name")
    )
    return E.route_files(named, ext_routes(spark))


@query(
    "split_supported",
    rf"""WITH {ROUTES_SQL},
named AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages),
exts AS (SELECT *, regexp_extract(lower(name), '(\.[^.]*)$', 1) AS ext FROM named)
SELECT e.page_id, r.ext IS NOT NULL AS accepted,
       CASE WHEN r.ext IS NULL THEN 'Unsupported file type: ' || CASE WHEN e.ext = '' THEN '(none)' ELSE e.ext END ELSE '' END AS reason
FROM exts e LEFT JOIN routes r ON r.ext = e.ext""",
)
def split_supported(spark, sf):
    named = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1).alias("name")
    )
    good, bad = E.split_supported(named, ext_routes(spark))
    return good.select("page_id", F.lit(True).alias("accepted"), F.lit("").alias("reason")).unionByName(
        bad.select("page_id", F.lit(False).alias("accepted"), "reason")
    )


@query(
    "modality_of",
    """WITH f AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'png' WHEN 'error' THEN 'wav' WHEN 'purchase' THEN 'csv'
                   WHEN 'signup' THEN 'mp4' ELSE 'md' END AS output_format FROM events)
SELECT event_id, output_format, CASE output_format WHEN 'png' THEN 'image' WHEN 'wav' THEN 'audio' WHEN 'csv' THEN 'table'
       WHEN 'mp4' THEN 'video' ELSE 'text' END AS modality FROM f""",
)
def modality(spark, sf):
    fmt = F.expr(
        "CASE event_type WHEN 'click' THEN 'png' WHEN 'error' THEN 'wav' WHEN 'purchase' THEN 'csv' WHEN 'signup' THEN 'mp4' ELSE 'md' END"
    )
    return table(spark, sf, "events").select("event_id", fmt.alias("output_format")).withColumn(
        "modality", E.modality_of(F.col("output_format"))
    )


@query("decode_text", "SELECT page_id, sha256(html || chr(65533) || 'x') AS text_hash, length(html) + 2 AS n FROM pages")
def decode_text(spark, sf):
    raw = table(spark, sf, "pages").select(
        "page_id", F.concat(F.col("html").cast("binary"), F.lit(bytearray(b"\xffx"))).alias("content")
    )
    return E.decoded(raw).select("page_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n"))


@query(
    "parse_metadata",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE props->>'$.k' END AS k,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END::bigint AS n_keys FROM events""",
)
def parse_metadata(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_type = 'error' THEN concat('not json ', props) ELSE props END").alias("metadata")
    )
    return E.parse_metadata(raw).select(
        "event_id",
        F.coalesce(F.try_element_at("metadata", F.lit("k")), F.lit("")).alias("k"),
        F.size("metadata").cast("long").alias("n_keys"),
    )


@query(
    "url_entities",
    r"""WITH b AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages)
SELECT substr(sha256(bare), 1, 16) AS entity_id, max_by(url, page_id) AS url, max(page_id) AS page_id FROM b GROUP BY 1""",
)
def url_entities(spark, sf):
    return E.url_entities(table(spark, sf, "pages").select("page_id", "url"), "url_hash", "page_id")


@query(
    "url_entities_html",
    """WITH b AS (SELECT page_id, html, substr(sha256(regexp_replace(url, '#.*$', '')), 1, 16) AS entity_id FROM pages)
SELECT entity_id, page_id, sha256(html) AS html_hash FROM b QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY page_id DESC) = 1""",
)
def url_entities_html(spark, sf):
    """The last fetch of each URL with its body, read again by its place."""
    rows = E.url_entities(located(table(spark, sf, "pages")), "url_hash", "page_id")
    return rows.select("entity_id", "page_id", F.sha2("html", 256).alias("html_hash"))


@query(
    "url_path_entities",
    r"""WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS hp FROM pages)
SELECT rtrim(hp, '/') AS entity_id, max_by(url, page_id) AS url, max(page_id) AS page_id FROM b GROUP BY 1""",
)
def url_path_entities(spark, sf):
    return E.url_entities(table(spark, sf, "pages").select("page_id", "url"), "url_path", "page_id")


@query(
    "chunk_ids",
    """SELECT conv_id, turn, 'conv_' || conv_id || '/' || role || '/#' || turn AS chunk_id, 'conv_' || conv_id AS entity_id,
       role AS rep_type, turn AS chunk_index FROM conversations""",
)
def chunk_ids(spark, sf):
    ids = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        E.chunk_id(F.concat(F.lit("conv_"), F.col("conv_id")), F.col("role"), F.col("turn")).alias("chunk_id"),
    )
    return ids.withColumn("_p", E.parse_chunk_id(F.col("chunk_id"))).select("conv_id", "turn", "chunk_id", "_p.*")


RULES = [("http://", "plain"), ("https://", "secure"), ("https://blog.", "blog"), ("https://www.", "www"), ("http://www.", "www")]


@query(
    "match_rules",
    "WITH rules(prefix, rule) AS (VALUES "
    + ", ".join(f"('{p}', '{r}')" for p, r in RULES)
    + """)
SELECT page_id, url AS path, max_by(rule, length(prefix)) AS rule FROM pages LEFT JOIN rules ON starts_with(url, prefix)
GROUP BY page_id, url""",
)
def match_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "prefix string, rule string")
    return E.match_rules(table(spark, sf, "pages").select("page_id", F.col("url").alias("path")), rules)


STATUS_SQL = """stat AS (
  SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN 'hidden' WHEN l.quality = 0 THEN 'deleted' ELSE 'enabled' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def with_status(spark, sf, heavy=False):
    """Documents as entities whose status comes from the labels; ``heavy`` where the
    texts are costly to process."""
    source = texts(spark, sf) if heavy else table(spark, sf, "documents")
    docs = source.join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id"),
        F.expr("CASE WHEN toxic = 1 THEN 'hidden' WHEN quality = 0 THEN 'deleted' ELSE 'enabled' END").alias("status"),
        F.col("lang").alias("workspace_id"),
        F.col("source").alias("collection_id"),
        F.sha2("text", 256).substr(1, 16).alias("content_hash"),
        F.lit(1).alias("version"),
        F.array("lang").alias("labels"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
        "doc_id",
        "text",
    )


@query("list_entities", f"WITH {STATUS_SQL} SELECT 'doc_' || doc_id AS entity_id, status FROM stat WHERE status = 'enabled'")
def list_entities(spark, sf):
    return E.list_entities(with_status(spark, sf).select("entity_id", "status"), "enabled")


@query("get_entities", "SELECT 'doc_' || doc_id AS entity_id, lang AS workspace_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def get_entities(spark, sf):
    base = with_status(spark, sf).select(*E.ENTITY_KEY, "doc_id")
    ids = base.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return E.get_entities(base, ids).select("entity_id", "workspace_id")


@query(
    "validate_ids",
    r"""SELECT c_custkey, id, CASE WHEN id = '' THEN 'empty' WHEN contains(id, '..') OR contains(id, '/') OR contains(id, '\') THEN 'path characters'
       WHEN NOT regexp_full_match(id, '[a-zA-Z0-9_.\-]+') THEN 'characters not allowed' ELSE '' END AS reason
FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'MACHINERY' THEN '' WHEN 'AUTOMOBILE' THEN '../' || c_name
             WHEN 'FURNITURE' THEN replace(c_name, '#', '_') ELSE 'a\' || c_name END AS id FROM customer)""",
)
def validate_ids(spark, sf):
    ids = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit(""))
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("../"), "c_name"))
        .when(F.col("c_mktsegment") == "FURNITURE", F.replace("c_name", F.lit("#"), F.lit("_")))
        .otherwise(F.concat(F.lit("a\\"), "c_name")).alias("id"),
    )
    good, bad = E.validate_ids(ids, "id")
    return good.withColumn("reason", F.lit("")).unionByName(bad)


@query(
    "filter_files",
    """SELECT page_id, url FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS name, octet_length(encode(html)) AS size FROM pages)
WHERE size <= 0.003 * 1024 * 1024 AND ends_with(lower(name), '.html') AND NOT contains(name, 'spam')
   OR size <= 0.003 * 1024 * 1024 AND regexp_extract(lower(name), '(\\.[^.]*)$', 1) = '.htm' AND NOT contains(name, 'spam')""",
)
def filter_files(spark, sf):
    named = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("name"),
        F.octet_length("html").alias("length"),
    )
    return E.filter_files(named, [".html", ".HTM"], 0.003, ["*spam*"]).select("page_id", "url")


@query(
    "event_history",
    "SELECT event_id, user_id, value FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1000)",
)
def event_history(spark, sf):
    return E.event_history(table(spark, sf, "events"), "error", 1000).select("event_id", "user_id", "value")


@query(
    "event_history_by_type",
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::bigint AS rank
FROM events QUALIFY rank <= 50""",
)
def event_history_by_type(spark, sf):
    return E.event_history_by_type(table(spark, sf, "events"), 50).select(
        "event_type", "event_id", F.col("rank").cast("long").alias("rank")
    )


@query(
    "patch_entities",
    """SELECT 'doc_' || d.doc_id AS entity_id, CASE WHEN l.toxic = 1 THEN 'hidden' ELSE 'enabled' END AS status,
       CASE WHEN l.quality = 1 THEN 'good' ELSE d.lang END AS labels, 1 AS version,
       CASE WHEN l.doc_id IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS updated_on,
       CASE WHEN l.doc_id IS NULL THEN '' ELSE 'update' END AS trigger
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def patch_entities(spark, sf):
    patches = with_status(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        *E.ENTITY_KEY,
        F.when(F.col("toxic") == 1, F.lit("hidden")).alias("status"),
        F.when(F.col("quality") == 1, F.array(F.lit("good"))).alias("labels"),
    )
    base = with_status(spark, sf).withColumn("status", F.lit("enabled")).drop("text")
    updated, log = E.patch_entities(base, patches, now())
    return updated.join(log.select("entity_id", "trigger"), "entity_id", "left").select(
        "entity_id", "status", F.array_join("labels", ",").alias("labels"), "version",
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"),
        F.coalesce("trigger", F.lit("")).alias("trigger"),
    )


@query(
    "update_content",
    """SELECT 'doc_' || d.doc_id AS entity_id,
       CASE WHEN l.quality = 1 THEN substr(sha256(d.text || '!'), 1, 16) ELSE substr(sha256(d.text), 1, 16) END AS content_hash,
       CASE WHEN l.quality = 1 THEN 2 ELSE 1 END AS version, CASE WHEN l.quality = 1 THEN 'content_update' ELSE '' END AS trigger,
       CASE WHEN l.quality = 1 THEN 'source_original' ELSE '' END AS changed_rep
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def update_content(spark, sf):
    base = with_status(spark, sf)
    new = base.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select(
        *E.ENTITY_KEY, F.when(F.col("quality") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")
    )
    updated, log, reps = E.update_content(base.drop("text"), new, now())
    joined = updated.join(log.select("entity_id", "trigger"), "entity_id", "left").join(
        reps.select("entity_id", F.col("rep_type").alias("changed_rep")), "entity_id", "left"
    )
    return joined.select(
        "entity_id", "content_hash", "version", F.coalesce("trigger", F.lit("")).alias("trigger"),
        F.coalesce("changed_rep", F.lit("")).alias("changed_rep"),
    )


@query(
    "delete_entities",
    """SELECT 'doc_' || doc_id AS entity_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'deleted' ELSE 'enabled' END AS status,
       doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AS kept_by_hard_delete FROM documents""",
)
def delete_entities(spark, sf):
    base = with_status(spark, sf).select("entity_id", F.lit("enabled").alias("status"), "updated_at")
    key = F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id")
    labels = table(spark, sf, "labels")
    soft = E.delete_entities(base, labels.filter("toxic = 1").select(key), now())
    hard = E.delete_entities(base, labels.filter("quality = 0").select(key), now(), hard=True)
    return soft.join(hard.select("entity_id", F.lit(True).alias("k")), "entity_id", "left").select(
        "entity_id", "status", F.coalesce("k", F.lit(False)).alias("kept_by_hard_delete")
    )


@query(
    "delete_one_scope",
    """WITH e AS (SELECT DISTINCT lang, source, substr(sha256(text), 1, 16) AS h FROM documents),
gone AS (SELECT DISTINCT lang, source, substr(sha256(text), 1, 16) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT lang AS workspace_id, source AS collection_id, h AS entity_id FROM e ANTI JOIN gone USING (lang, source, h)""",
)
def delete_one_scope(spark, sf):
    """Ids are content hashes: a copy in another collection keeps its row."""
    base = with_status(spark, sf).drop("entity_id").withColumnRenamed("content_hash", "entity_id")
    poor = base.join(table(spark, sf, "labels").filter("quality = 0"), "doc_id", "left_semi")
    entities = base.select(*E.ENTITY_KEY, "status", "updated_at").dropDuplicates(E.ENTITY_KEY)
    return E.delete_entities(entities, poor, now(), hard=True).select(*E.ENTITY_KEY)


@query(
    "drop_collections",
    """WITH doomed AS (SELECT DISTINCT lang, source FROM documents WHERE lang IN ('fr', 'de')),
active AS (SELECT DISTINCT d.lang, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)
SELECT doc_id, lang AS workspace_id, source AS collection_id FROM documents
WHERE (lang, source) NOT IN (SELECT (lang, source) FROM doomed WHERE (lang, source) NOT IN (SELECT (lang, source) FROM active))""",
)
def drop_collections(spark, sf):
    rows = with_status(spark, sf).select("doc_id", "workspace_id", "collection_id")
    doomed = rows.filter(F.col("workspace_id").isin("fr", "de")).select("workspace_id", "collection_id").distinct()
    watches = rows.join(table(spark, sf, "labels"), "doc_id").select(
        "workspace_id", "collection_id", F.when(F.col("toxic") == 1, F.lit("active")).otherwise(F.lit("paused")).alias("status")
    )
    return E.drop_collections(rows, doomed, watches)[0]


@query("workspace_counts", "SELECT lang AS workspace_id, count(DISTINCT source) AS collection_count FROM documents GROUP BY 1")
def workspace_counts(spark, sf):
    return E.workspace_counts(files(spark, sf))


@query("collection_counts", f"WITH {ENT_SQL} SELECT workspace_id, collection_id, count(DISTINCT entity_id) AS entity_count FROM ent GROUP BY ALL")
def collection_counts(spark, sf):
    return E.collection_counts(E.with_content_id(files(spark, sf)))


@query(
    "chunk_counts",
    """SELECT 'doc_' || doc_id AS entity_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 0
       ELSE greatest(ceil((length(text) - 500) / 500.0), 0) + 1 END::bigint AS chunk_count FROM documents d""",
)
def chunk_counts(spark, sf):
    from tarn.operators.chunking import chunk_fixed

    base = with_status(spark, sf)
    poor = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    index = chunk_fixed(base.join(poor, "doc_id", "left_anti").select(*E.ENTITY_KEY, "text"), 500)
    return E.chunk_counts(base, index).select("entity_id", "chunk_count")


def reps_of(spark, sf, heavy=False):
    """Every document has a source; its canonical text is missing where quality is 0."""
    labels = table(spark, sf, "labels")
    base = with_status(spark, sf, heavy).join(labels, "doc_id", "left")
    source = base.select(
        "entity_id", F.lit("source_original").alias("rep_type"), "content_hash", F.lit("").alias("transform"),
        F.lit("active").alias("status"), "doc_id", "text",
    )
    canonical = base.filter("quality IS NULL OR quality = 1").select(
        "entity_id", F.lit("canonical_md").alias("rep_type"), "content_hash", F.lit("passthru").alias("transform"),
        F.expr("CASE WHEN toxic = 1 THEN 'stale' ELSE 'active' END").alias("status"), "doc_id", "text",
    )
    return source.unionByName(canonical)


@query(
    "stage_status",
    """WITH base AS (SELECT d.doc_id, substr(sha256(text), 1, 16) AS h, length(text) AS n, coalesce(quality, 1) = 1 AS canon,
                     coalesce(toxic, 0) AS toxic, quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_' || doc_id AS entity_id, CASE WHEN toxic = 1 THEN 'hidden' WHEN quality = 0 THEN 'deleted' ELSE 'enabled' END AS entity_status,
       CASE WHEN canon THEN 'completed' ELSE 'processing' END AS pipeline_stage,
       CASE WHEN canon THEN 'source_original,canonical_md' ELSE 'source_original' END AS present,
       CASE WHEN canon THEN 14 ELSE 15 END::bigint AS absent,
       CASE WHEN canon AND toxic = 0 THEN 2 ELSE 1 END::bigint AS active_reps,
       CASE WHEN canon THEN greatest(ceil((n - 500) / 500.0), 0) + 1 ELSE 0 END::bigint AS chunk_count, canon AS indexed FROM base""",
)
def stage_status(spark, sf):
    from tarn.operators.chunking import chunk_fixed

    reps = reps_of(spark, sf)
    index = chunk_fixed(reps.filter("rep_type = 'canonical_md'").select("entity_id", "text"), 500)
    status = E.pipeline_status(with_status(spark, sf).select("entity_id", "status"), reps, index)
    return status.select(
        "entity_id", "entity_status", "pipeline_stage",
        F.array_join(F.transform(F.filter("reps", lambda r: r["exists"]), lambda r: r["rep_type"]), ",").alias("present"),
        F.size(F.filter("reps", lambda r: ~r["exists"])).cast("long").alias("absent"),
        F.size(F.filter("reps", lambda r: r["indexed"])).cast("long").alias("active_reps"),
        "chunk_count", "indexed",
    )


@query(
    "quota_report",
    """WITH used AS (SELECT lang AS workspace_id, source AS collection_id, count(*) AS entities, sum(n_chars)::bigint AS storage,
                  sum(greatest(ceil((length(text) - 500) / 500.0), 0) + 1)::bigint AS chunks FROM documents GROUP BY 1, 2)
SELECT workspace_id, collection_id, entities, chunks, storage, entities > 20 OR chunks > 150 OR storage > 60000 AS exceeded FROM used""",
)
def quota_report(spark, sf):
    from tarn.operators.chunking import chunk_fixed

    base = with_status(spark, sf)
    index = chunk_fixed(base.select("workspace_id", "collection_id", "entity_id", "text"), 500)
    quotas = base.select("workspace_id", "collection_id").distinct().select(
        "*", F.lit(20).alias("max_entities"), F.lit(150).alias("max_chunks"), F.lit(60000).alias("max_storage")
    )
    usage = base.withColumn("size", F.length("text").cast("long"))
    return E.quota_report(usage, index, quotas).select(
        "workspace_id", "collection_id", "entities", "chunks", "storage", "exceeded"
    )

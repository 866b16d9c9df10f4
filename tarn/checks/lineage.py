"""Lineage, drift and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.checks.base import query, table
from tarn.checks.entities import now, reps_of, with_status
from tarn.operators import lineage as L
from tarn.operators.chunking import chunk_fixed
from tarn.operators.entities import ENTITY_KEY
from tarn.schema import lineage_rules

RULES_SQL = """rules(input_rep, output_rep) AS (VALUES ('source_original', 'canonical_md'), ('source_original', 'rep_pdf'),
  ('rep_pdf', 'page_image'), ('page_image', 'canonical_md')),
walk(input_rep, output_rep, depth) AS (
  SELECT input_rep, output_rep, 1 FROM rules
  UNION ALL SELECT w.input_rep, r.output_rep, w.depth + 1 FROM walk w JOIN rules r ON r.input_rep = w.output_rep)"""

# Which rep of a document changed follows its language.
CHANGED = "CASE lang WHEN 'en' THEN 'source_original' WHEN 'fr' THEN 'rep_pdf' WHEN 'de' THEN 'page_image' ELSE 'canonical_md' END"


def changes(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id"), F.expr(CHANGED).alias("rep_type")
    )


@query(
    "cascade_stale",
    f"""WITH RECURSIVE {RULES_SQL}
SELECT DISTINCT 'doc_' || doc_id AS entity_id, w.output_rep AS rep_type FROM documents JOIN walk w ON w.input_rep = {CHANGED}""",
)
def cascade_stale(spark, sf):
    return L.cascade_stale(changes(spark, sf), lineage_rules(spark))


@query(
    "mark_stale",
    f"""WITH RECURSIVE {RULES_SQL}, hit AS (SELECT DISTINCT doc_id, w.output_rep AS rep_type FROM documents JOIN walk w ON w.input_rep = {CHANGED}),
reps AS (
  SELECT doc_id, 'source_original' AS rep_type, 'active' AS status FROM documents
  UNION ALL SELECT d.doc_id, 'canonical_md', CASE WHEN toxic = 1 THEN 'stale' ELSE 'active' END FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 1) = 1)
SELECT 'doc_' || r.doc_id AS entity_id, r.rep_type, CASE WHEN h.doc_id IS NOT NULL THEN 'stale' ELSE r.status END AS status
FROM reps r LEFT JOIN hit h USING (doc_id, rep_type)""",
)
def mark_stale(spark, sf):
    stale = L.cascade_stale(changes(spark, sf), lineage_rules(spark))
    return L.mark_stale(reps_of(spark, sf).select("entity_id", "rep_type", "status"), stale)


@query(
    "stale_reps",
    """SELECT 'doc_' || doc_id AS entity_id, 'canonical_md' AS rep_type FROM labels WHERE toxic = 1 AND quality = 1
UNION SELECT 'doc_' || doc_id, 'summary' FROM labels WHERE quality = 0""",
)
def stale_reps(spark, sf):
    tags = table(spark, sf, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("entity_id"), F.lit("summary").alias("rep_type"),
        F.expr("CASE WHEN quality = 0 THEN 'stale' ELSE 'active' END").alias("status"),
    )
    return L.stale_reps(reps_of(spark, sf).select("entity_id", "rep_type", "status"), tags).select("entity_id", "rep_type")


@query(
    "rebuild_stale",
    """SELECT 'doc_' || doc_id AS entity_id, length(text) AS n, greatest(ceil((length(text) - 500) / 500.0), 0)::bigint + 1 AS chunks, 0::bigint AS still_stale
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 1)""",
)
def rebuild_stale(spark, sf):
    reps = reps_of(spark, sf)
    todo, done = L.rebuild_stale(
        reps.select("entity_id", "rep_type", "status"), reps.filter("rep_type = 'source_original'").select("entity_id", "text")
    )
    counts = chunk_fixed(todo, 500).groupBy("entity_id").agg(F.count(F.lit(1)).alias("chunks"))
    left = done.filter("status = 'stale'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("s"))
    return todo.select("entity_id", F.length("text").cast("long").alias("n")).join(counts, "entity_id").join(
        left, "entity_id", "left"
    ).select("entity_id", "n", "chunks", F.coalesce("s", F.lit(0).cast("long")).alias("still_stale"))


@query(
    "lineage_queries",
    f"""WITH RECURSIVE {RULES_SQL}, far AS (SELECT input_rep, output_rep, max(depth) AS depth FROM walk GROUP BY ALL)
SELECT event_id, output_rep AS rep_type, depth, 'downstream' AS direction FROM events JOIN far ON input_rep = 'source_original' WHERE event_type IN ('error', 'click')
UNION ALL SELECT event_id, input_rep, depth, 'upstream' FROM events JOIN far ON output_rep = 'canonical_md' WHERE event_type NOT IN ('error', 'click')""",
)
def lineage_queries(spark, sf):
    rules, events = lineage_rules(spark), table(spark, sf, "events")
    down = L.lineage(rules, "source_original").withColumn("direction", F.lit("downstream"))
    up = L.lineage(rules, "canonical_md", "upstream").withColumn("direction", F.lit("upstream"))
    asked = F.when(F.col("event_type").isin("error", "click"), F.lit("downstream")).otherwise(F.lit("upstream"))
    return events.select("event_id", asked.alias("direction")).join(F.broadcast(down.unionByName(up)), "direction")


@query(
    "rebuild_order",
    f"""WITH RECURSIVE {RULES_SQL}, hit AS (SELECT DISTINCT 'doc_' || doc_id AS entity_id, w.output_rep AS rep_type FROM documents JOIN walk w ON w.input_rep = {CHANGED})
SELECT entity_id, rep_type, (SELECT max(depth) FROM walk WHERE output_rep = rep_type) AS step_order FROM hit""",
)
def rebuild_order(spark, sf):
    rules = lineage_rules(spark)
    return L.rebuild_order(L.cascade_stale(changes(spark, sf), rules), rules)


def drift_inputs(spark, sf):
    """Metadata is missing for Spanish documents, the canonical text where quality is
    0, the recorded hash is outdated where toxic is 1, and only labelled documents
    are indexed; very long ones have an unknown file."""
    base = with_status(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    dirs = base.select(*ENTITY_KEY)
    meta = base.filter("workspace_id <> 'es'").select(
        *ENTITY_KEY, F.expr("CASE WHEN toxic = 1 THEN 'outdated' ELSE content_hash END").alias("content_hash")
    )
    rep = lambda df, kind: df.select(*ENTITY_KEY, F.lit(kind).alias("rep_type"), "content_hash")
    reps = (
        rep(base.filter("workspace_id <> 'de' OR toxic IS NULL"), "source_original")
        .unionByName(rep(base.filter("quality IS NULL OR quality = 1"), "canonical_md"))
        .unionByName(rep(base.filter(F.length("text") > 5000), "notes"))
    )
    piece = lambda df: chunk_fixed(df.select(*ENTITY_KEY, F.lit("canonical_md").alias("rep_name"), "text"), 500)
    index = piece(base.filter("quality IS NOT NULL"))
    chunks = piece(base.withColumn("text", F.expr("CASE WHEN toxic = 1 THEN concat(text, '!') ELSE text END")))
    return dirs, meta, reps, index, chunks


DRIFT_SQL = """base AS (
  SELECT d.doc_id, 'doc_' || d.doc_id AS entity_id, lang, quality, toxic, length(text) AS n,
         substr(sha256(text), 1, 16) AS h, lang <> 'es' AS has_meta, lang <> 'de' OR toxic IS NULL AS has_source,
         quality IS NULL OR quality = 1 AS has_canon FROM documents d LEFT JOIN labels l USING (doc_id)),
drifts AS (
  SELECT entity_id, has_source, 'missing_meta' AS drift_type, 'no tags and no manifest' AS detail FROM base WHERE NOT has_meta
  UNION ALL SELECT entity_id, has_source, 'missing_rep', 'required rep source_original not found' FROM base WHERE has_meta AND NOT has_source
  UNION ALL SELECT entity_id, has_source, 'missing_rep', 'required rep canonical_md not found' FROM base WHERE has_meta AND NOT has_canon
  UNION ALL SELECT entity_id, has_source, 'stale_rep', 'recorded=outdated, actual=' || h FROM base WHERE has_meta AND has_source AND has_canon AND toxic = 1
  UNION ALL SELECT entity_id, has_source, 'missing_index', 'canonical_md is not indexed' FROM base WHERE has_canon AND quality IS NULL
  UNION ALL SELECT entity_id, has_source, 'extra_file', 'notes' FROM base WHERE n > 5000
  UNION ALL SELECT entity_id, has_source, 'stale_index', 'index differs from the chunks' FROM base WHERE quality IS NOT NULL AND toxic = 1),
plan AS (
  SELECT *, CASE WHEN drift_type IN ('stale_rep', 'missing_rep') THEN 'rerun' WHEN drift_type IN ('stale_index', 'missing_index') THEN 'resync' ELSE 'none' END AS action FROM drifts)"""


@query("detect_drift", f"WITH {DRIFT_SQL} SELECT entity_id, drift_type, detail FROM drifts")
def detect_drift(spark, sf):
    return L.detect_drift(*drift_inputs(spark, sf)).select("entity_id", "drift_type", "detail")


FEASIBLE = "CASE action WHEN 'rerun' THEN has_source WHEN 'resync' THEN true ELSE false END"


def _plan(spark, sf):
    dirs, meta, reps, index, chunks = drift_inputs(spark, sf)
    drifts = L.detect_drift(dirs, meta, reps, index, chunks)
    return dirs, L.repair_plan(drifts, reps.filter("rep_type = 'source_original'"))


@query(
    "repair_plan",
    f"WITH {DRIFT_SQL} SELECT entity_id, drift_type, action, {FEASIBLE} AS feasible, CASE WHEN action = 'rerun' AND has_source THEN 1 ELSE 0 END AS version_bump FROM plan",
)
def repair_plan(spark, sf):
    return _plan(spark, sf)[1].select("entity_id", "drift_type", "action", "feasible", "version_bump")


@query(
    "reconcile_report",
    f"""WITH {DRIFT_SQL}
SELECT coalesce(drift_type, 'total') AS drift_type, CASE WHEN drift_type IS NULL THEN (SELECT count(*) FROM documents) ELSE 0 END AS scanned, count(*) AS drifts,
       count_if({FEASIBLE})::bigint AS repaired, count_if(action <> 'none' AND NOT ({FEASIBLE}))::bigint AS errors FROM plan GROUP BY ROLLUP (drift_type)""",
)
def reconcile_report(spark, sf):
    dirs, plan = _plan(spark, sf)
    return L.reconcile_report(dirs, plan)


@query(
    "check_inheritance",
    """WITH b AS (SELECT 'doc_' || d.doc_id AS entity_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT entity_id, 'canonical_md' AS rep_type, CASE WHEN lang = 'es' THEN 'file_missing' WHEN toxic = 1 THEN 'input_changed' ELSE 'pipeline_changed' END AS problem
FROM b WHERE lang = 'es' OR toxic = 1 OR quality = 0""",
)
def check_inheritance(spark, sf):
    base = with_status(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    source = base.select(
        "entity_id", F.lit("source_original").alias("rep_type"), "content_hash", F.lit("").alias("input_content_hash"),
        F.lit("2").alias("pipeline_version"),
    )
    canonical = base.select(
        "entity_id", F.lit("canonical_md").alias("rep_type"),
        F.expr("CASE WHEN workspace_id <> 'es' THEN sha2(concat(text, 'md'), 256) END").alias("content_hash"),
        F.expr("CASE WHEN toxic = 1 THEN 'old' ELSE content_hash END").alias("input_content_hash"),
        F.expr("CASE WHEN quality = 0 THEN '1' ELSE '2' END").alias("pipeline_version"),
    )
    return L.check_inheritance(source.unionByName(canonical), lineage_rules(spark), "2").select("entity_id", "rep_type", "problem")


@query(
    "index_status",
    """WITH b AS (SELECT 'doc_' || d.doc_id AS entity_id, lang, quality, toxic, substr(sha256(text), 1, 16) AS h1, substr(sha256(text || 'x'), 1, 16) AS h2,
                  coalesce(quality, 1) = 1 AS r1, coalesce(toxic, 0) = 0 AS r2 FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, sha256(CASE WHEN r1 AND r2 THEN least(h1, h2) || greatest(h1, h2) WHEN r1 THEN h1 WHEN r2 THEN h2 ELSE '' END) AS hs FROM b)
SELECT entity_id, hs AS build_from_hash_set, CASE lang WHEN 'en' THEN 'built' WHEN 'fr' THEN 'missing' ELSE 'stale' END AS index_status,
       CASE WHEN lang = 'en' THEN 'skip' WHEN NOT r1 THEN 'wait' WHEN NOT r2 THEN 'partial' ELSE 'rebuild' END AS action FROM s""",
)
def index_status(spark, sf):
    base = with_status(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    one = base.select("entity_id", F.lit("canonical_md").alias("rep_type"), "content_hash",
                      F.expr("CASE WHEN quality = 0 THEN 'stale' ELSE 'active' END").alias("status"))
    two = base.select("entity_id", F.lit("summary").alias("rep_type"), F.sha2(F.concat("text", F.lit("x")), 256).substr(1, 16).alias("content_hash"),
                      F.expr("CASE WHEN toxic = 1 THEN 'stale' ELSE 'active' END").alias("status"))
    reps = one.unionByName(two)
    none = base.select("entity_id", F.lit("").alias("index_built_from_hash"), F.lit("").alias("model_version")).limit(0)
    current = L.index_status(reps, none, ["canonical_md"], "m1").select("entity_id", "build_from_hash_set")
    built = base.filter("workspace_id <> 'fr'").join(current, "entity_id").select(
        "entity_id",
        F.expr("CASE WHEN workspace_id = 'de' THEN 'other' ELSE build_from_hash_set END").alias("index_built_from_hash"),
        F.expr("CASE WHEN workspace_id = 'es' THEN 'm0' ELSE 'm1' END").alias("model_version"),
    )
    return L.index_status(reps, built, ["canonical_md"], "m1")


@query(
    "audit_hashes",
    """SELECT 'doc_' || doc_id AS entity_id, 'wrong' AS content_hash, substr(sha256(text), 1, 16) AS actual_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def audit_hashes(spark, sf):
    base = with_status(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    recorded = base.select("entity_id", F.expr("CASE WHEN toxic = 1 THEN 'wrong' ELSE content_hash END").alias("content_hash"), F.col("text").alias("content"))
    return L.audit_hashes(recorded)


@query(
    "rebuild_metadata",
    """SELECT 'doc_' || doc_id AS entity_id, 'canonical_md' AS rep_type, 'md_passthru' AS transform, substr(sha256(text), 1, 16) AS input_content_hash,
       substr(sha256(text || 'md'), 1, 16) AS content_hash, 'stale' AS status FROM documents
UNION ALL SELECT 'doc_' || doc_id, 'source_original', '', '', substr(sha256(text), 1, 16), 'stale' FROM documents""",
)
def rebuild_metadata(spark, sf):
    base = with_status(spark, sf)
    row = lambda kind, content: base.select(*ENTITY_KEY, F.lit(kind).alias("rep_type"), content.alias("content"), F.length("text").alias("size"))
    files = row("source_original", F.col("text")).unionByName(row("canonical_md", F.concat("text", F.lit("md"))))
    reps, _ = L.rebuild_metadata(files, lineage_rules(spark))
    return reps.select(
        "entity_id", "rep_type", F.coalesce("transform", F.lit("")).alias("transform"),
        F.coalesce("input_content_hash", F.lit("")).alias("input_content_hash"), "content_hash", "status",
    )


@query(
    "publish",
    """SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS version,
       (CASE WHEN event_type = 'view' THEN 2 ELSE 1 END) = (max(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) OVER (PARTITION BY user_id)) AS active FROM events""",
)
def publish(spark, sf):
    events = table(spark, sf, "events")
    index = events.select("event_id", "user_id", F.col("user_id").alias("entity_id"), F.expr("CASE WHEN event_type = 'view' THEN 2 ELSE 1 END").alias("version"))
    live = events.select(F.col("user_id").alias("entity_id"), F.expr("CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END").alias("version"))
    return L.publish(index, live).drop("entity_id")


def event_log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("entity_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("version"), F.col("event_type").alias("trigger")
    )


@query(
    "as_of_time",
    "SELECT user_id AS entity_id, max_by(event_id, ts) AS version, max_by(event_type, ts) AS trigger FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1",
)
def as_of_time(spark, sf):
    return L.as_of(event_log(spark, sf), F.lit("2024-01-15 12:00:00").cast("timestamp")).select("entity_id", "version", "trigger")


@query(
    "as_of_version",
    "SELECT user_id AS entity_id, max(event_id) AS version FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1",
)
def as_of_version(spark, sf):
    top = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    return L.as_of(event_log(spark, sf), version=top // 2).select("entity_id", "version")


@query(
    "classify_changes",
    """WITH b AS (SELECT 'doc_' || d.doc_id AS entity_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT entity_id, 'raw' AS scope, 'source_original' AS name, 'C1' AS change FROM b WHERE toxic = 1
UNION ALL SELECT entity_id, 'rep', 'canonical_md', CASE WHEN toxic = 1 THEN 'C2' ELSE 'C3' END FROM b WHERE toxic = 1 OR quality = 0
UNION ALL SELECT entity_id, 'index', 'text_index', 'C4' FROM b WHERE lang = 'fr'
UNION ALL SELECT entity_id, 'schema', 'model', 'C5' FROM b WHERE lang = 'de'
UNION ALL SELECT entity_id, 'entity', 'labels', 'C6' FROM b WHERE quality = 1
UNION ALL SELECT entity_id, 'projector', 'wiki', 'C7' FROM b WHERE lang = 'es'""",
)
def classify_changes(spark, sf):
    base = with_status(spark, sf).drop("status", "labels").join(table(spark, sf, "labels"), "doc_id", "left")

    def state(scope, name, content, status):
        return base.select("entity_id", F.lit(scope).alias("scope"), F.lit(name).alias("name"), F.expr(content).alias("content_hash"), F.expr(status).alias("status"))

    def snapshot(parts):
        out = state(*parts[0])
        for p in parts[1:]:
            out = out.unionByName(state(*p))
        return out

    old = snapshot([
        ("raw", "source_original", "content_hash", "'active'"), ("rep", "canonical_md", "content_hash", "'active'"),
        ("index", "text_index", "content_hash", "'built'"), ("schema", "model", "'m1'", "'active'"), ("entity", "labels", "'a'", "'enabled'"),
    ])
    new = snapshot([
        ("raw", "source_original", "CASE WHEN toxic = 1 THEN 'new' ELSE content_hash END", "'active'"),
        ("rep", "canonical_md", "CASE WHEN toxic = 1 THEN 'new' ELSE content_hash END", "CASE WHEN quality = 0 THEN 'stale' ELSE 'active' END"),
        ("index", "text_index", "content_hash", "CASE WHEN workspace_id = 'fr' THEN 'stale' ELSE 'built' END"),
        ("schema", "model", "CASE WHEN workspace_id = 'de' THEN 'm2' ELSE 'm1' END", "'active'"),
        ("entity", "labels", "CASE WHEN quality = 1 THEN 'b' ELSE 'a' END", "'enabled'"),
    ]).unionByName(base.filter("workspace_id = 'es'").select(
        "entity_id", F.lit("projector").alias("scope"), F.lit("wiki").alias("name"), F.lit("p").alias("content_hash"), F.lit("on").alias("status")))
    return L.classify_changes(old, new)


def order_edges(spark, sf):
    """Edges from customers to the parts they ordered."""
    return (
        table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    )


EDGES_SQL = "edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(
    "edge_status",
    f"""WITH {EDGES_SQL}, e AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'deleted' ELSE 'enabled' END AS s FROM customer
   UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size < 5 THEN 'stale' WHEN p_size > 45 THEN 'deleted' ELSE 'enabled' END FROM part)
SELECT src, dst, CASE WHEN a.s = 'deleted' OR b.s = 'deleted' THEN 'deleted' WHEN a.s = 'stale' OR b.s = 'stale' THEN 'stale' ELSE 'active' END AS status
FROM edges JOIN e a ON a.id = src JOIN e b ON b.id = dst""",
)
def edge_status(spark, sf):
    entities = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("entity_id"), F.expr("CASE WHEN c_acctbal < 0 THEN 'deleted' ELSE 'enabled' END").alias("status")
    ).unionByName(table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("entity_id"),
        F.expr("CASE WHEN p_size < 5 THEN 'stale' WHEN p_size > 45 THEN 'deleted' ELSE 'enabled' END").alias("status")))
    return L.edge_status(order_edges(spark, sf), entities)


@query(
    "neighbors",
    """WITH edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier
   UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
h0 AS (SELECT 'r' || r_regionkey AS id FROM region WHERE r_name IN ('ASIA', 'EUROPE')),
h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h1))
SELECT id AS entity_id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
)
def neighbors(spark, sf):
    def edge(name, a, x, b, y):
        return table(spark, sf, name).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))

    edges = edge("supplier", "s", "s_suppkey", "n", "s_nationkey").unionByName(
        edge("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey"))
    seeds = table(spark, sf, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("entity_id"))
    return L.neighbors(edges, seeds, 2)


@query(
    "rebuild_priority",
    """SELECT user_id AS entity_id, CASE WHEN date_diff('day', last::date, DATE '2024-02-01') <= 7 AND n > 60 THEN 'high'
       WHEN date_diff('day', last::date, DATE '2024-02-01') <= 30 THEN 'medium' ELSE 'low' END AS priority
FROM (SELECT user_id, max(ts) FILTER (WHERE event_type = 'error') AS last, count(*) AS n FROM events GROUP BY 1)""",
)
def rebuild_priority(spark, sf):
    seen = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity_id")).agg(
        F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_searched"),
        F.when(F.count(F.lit(1)) > 60, F.lit("enabled")).otherwise(F.lit("hidden")).alias("status"),
    )
    return L.rebuild_priority(seen, now()).select("entity_id", "priority")


@query(
    "purge",
    """SELECT event_id, NOT (event_type = 'error' AND ts < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY) AS kept FROM events""",
)
def purge(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'enabled' END").alias("status"), F.col("ts").alias("updated_at")
    )
    kept, gone = L.purge(rows, now(), 20)
    return kept.select("event_id", F.lit(True).alias("kept")).unionByName(gone.select("event_id", F.lit(False).alias("kept")))


@query("missing_entities", "SELECT page_id, url AS source_uri FROM pages WHERE url NOT LIKE '%.html'")
def missing_entities(spark, sf):
    listed = table(spark, sf, "pages").select("page_id", F.col("url").alias("source_uri"))
    return L.missing_entities(listed, listed.filter(F.col("source_uri").like("%.html")))


@query("orphaned_entities", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def orphaned_entities(spark, sf):
    entities = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("source_uri"))
    listed = table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("source_uri"))
    return L.orphaned_entities(entities, listed).select("o_orderkey")

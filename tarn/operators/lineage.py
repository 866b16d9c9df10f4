"""Lineage between representations: staleness, drift, repair, history, edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.sizes import broadcast_if_small
from tarn.functions.text import hash16
from tarn.operators.entities import ENTITY_KEY, entity_key
from tarn.schema import REP_DIMS, REQUIRED_REPS
from tarn.session import durable

# Reps that an error about a cycle names.
NAMED_REPS = 20
# Pairs of reps that may be broadcast.
SMALL_ROWS = 500_000


# --- the rule graph ----------------------------------------------------------------


def reachable(rules: DataFrame) -> DataFrame:
    """``input_rep, output_rep`` for every two reps with a path of rules between them.

    Each round extends the pairs found last; it ends when no new pair appears, so chains
    of any length and cycles are followed, and parallel paths count once.
    """
    edges = durable(rules.select("input_rep", "output_rep").distinct())
    found = fresh = edges
    while not fresh.isEmpty():
        fresh = durable(_one_step(fresh, edges).join(found, ["input_rep", "output_rep"], "left_anti"))
        found = found.unionByName(fresh)
    return found


def _one_step(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    onward = edges.select(F.col("input_rep").alias("output_rep"), F.col("output_rep").alias("_to"))
    return pairs.join(onward, "output_rep").select("input_rep", F.col("_to").alias("output_rep")).distinct()


def rule_closure(rules: DataFrame) -> DataFrame:
    """``input_rep, output_rep, depth`` for every two reps with a path of rules between
    them; ``depth`` is the length of the longest one.

    Round n holds the distinct pairs with a path of n rules. A cycle has no longest path:
    it is refused, with the reps that lie on it.
    """
    edges = durable(rules.select("input_rep", "output_rep").distinct())
    layers, layer = [], edges
    while not layer.isEmpty():
        layers.append(layer.withColumn("depth", F.lit(len(layers) + 1)))
        circular = layer.filter("input_rep = output_rep").orderBy("input_rep").limit(NAMED_REPS).collect()
        if circular:
            raise ValueError(f"rules go round in a circle at {[r['input_rep'] for r in circular]}")
        layer = durable(_one_step(layer, edges))
    if not layers:
        return edges.withColumn("depth", F.lit(0))
    return reduce(DataFrame.unionByName, layers).groupBy("input_rep", "output_rep").agg(F.max("depth").alias("depth"))


def cascade_stale(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Reps downstream of the changed ones, each once per entity.

    ``changes`` has the entity key and ``rep_type``.
    """
    keys = [c for c in changes.columns if c != "rep_type"]
    reach = reachable(rules).select(F.col("input_rep").alias("rep_type"), "output_rep")
    reach = broadcast_if_small(reach, SMALL_ROWS)
    return (
        changes.distinct().join(reach, "rep_type")
        .select(*keys, F.col("output_rep").alias("rep_type")).distinct()
    )


def mark_stale(reps: DataFrame, stale: DataFrame) -> DataFrame:
    """Set ``status`` of the stale reps that exist; others are not created."""
    keys = [c for c in stale.columns if c in reps.columns]
    hit = stale.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return reps.join(hit, keys, "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit("stale")).otherwise(F.col("status"))
    ).drop("_hit")


def stale_reps(manifest_reps: DataFrame, tag_reps: DataFrame | None = None) -> DataFrame:
    """Stale reps other than the source: by manifest, and by tag for entities of
    which the manifest names none."""
    wanted = (F.col("status") == "stale") & (F.col("rep_type") != "source_original")
    found = manifest_reps.filter(wanted)
    if tag_reps is None:
        return found
    keys = [c for c in ENTITY_KEY if c in found.columns]
    rest = tag_reps.filter(wanted).join(found.select(*keys).distinct(), keys, "left_anti")
    return found.unionByName(rest, allowMissingColumns=True)


def rebuild_stale(reps: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources of the entities with stale reps (to be chunked and synced again), and
    the reps with those entities' stale status reset."""
    keys = [c for c in ENTITY_KEY if c in reps.columns]
    affected = stale_reps(reps).select(*keys).distinct()
    todo = sources.join(affected, keys, "left_semi")
    ready = todo.select(*keys).distinct().withColumn("_ready", F.lit(True))
    reset = F.coalesce("_ready", F.lit(False)) & (F.col("status") == "stale")
    done = reps.join(ready, keys, "left").withColumn(
        "status", F.when(reset, F.lit("active")).otherwise(F.col("status"))
    ).drop("_ready")
    return todo, done


def lineage(rules: DataFrame, start: str, direction: str = "downstream") -> DataFrame:
    """Rep types reachable from ``start`` with the longest distance."""
    closure = rule_closure(rules)
    if direction == "downstream":
        return closure.filter(F.col("input_rep") == start).select(F.col("output_rep").alias("rep_type"), "depth")
    return closure.filter(F.col("output_rep") == start).select(F.col("input_rep").alias("rep_type"), "depth")


def rebuild_order(stale: DataFrame, rules: DataFrame) -> DataFrame:
    """``step_order`` for stale reps: a rep comes after everything it derives from."""
    depth = rule_closure(rules).groupBy(F.col("output_rep").alias("rep_type")).agg(F.max("depth").alias("step_order"))
    return stale.join(broadcast_if_small(depth, SMALL_ROWS), "rep_type", "left").withColumn(
        "step_order", F.coalesce("step_order", F.lit(0))
    )


# --- drift -------------------------------------------------------------------------


def detect_drift(dirs: DataFrame, meta: DataFrame, reps: DataFrame, index: DataFrame,
                 chunks: DataFrame | None = None) -> DataFrame:
    """Drift rows ``entity key, drift_type, detail``.

    ``dirs`` lists entity directories, ``meta`` the recorded ``content_hash`` per
    entity with a manifest or tags, ``reps`` the files with their actual
    ``content_hash``, ``index`` the indexed chunks and ``chunks`` the current
    ones. Everything is reduced to one row per entity and joined on its key, so
    there is one shuffle layout and no join per drift type.
    """
    known = [rep for rep, *_ in REP_DIMS]
    seen = reps.groupBy(*ENTITY_KEY).agg(
        *[F.coalesce(F.bool_or(F.col("rep_type") == r), F.lit(False)).alias(f"has_{r}") for r in REQUIRED_REPS],
        F.max(F.when(F.col("rep_type") == "source_original", F.col("content_hash"))).alias("actual"),
    )
    indexed = _fingerprint(index, "i")
    entities = (
        dirs.select(*ENTITY_KEY).distinct().filter(~F.startswith("entity_id", F.lit("_")))
        .join(meta.select(*ENTITY_KEY, F.coalesce("content_hash", F.lit("")).alias("recorded")), ENTITY_KEY, "left")
        .join(seen, ENTITY_KEY, "left")
        .join(indexed, ENTITY_KEY, "left")
    )
    if chunks is not None:
        entities = entities.join(_fingerprint(chunks, "c"), ENTITY_KEY, "left")

    def drift(when: Column, kind: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("drift_type"), detail.alias("detail")))

    has_meta = F.col("recorded").isNotNull()
    have = {r: F.coalesce(f"has_{r}", F.lit(False)) for r in REQUIRED_REPS}
    is_indexed = F.col("i_count").isNotNull()
    found = [
        drift(~has_meta, "missing_meta", F.lit("no tags and no manifest")),
        *[
            drift(has_meta & ~have[r], "missing_rep", F.lit(f"required rep {r} not found"))
            for r in REQUIRED_REPS
        ],
        drift(
            has_meta & have["source_original"] & have["canonical_md"] & (F.col("recorded") != "")
            & (F.col("actual") != F.col("recorded")),
            "stale_rep",
            F.concat(F.lit("recorded="), "recorded", F.lit(", actual="), "actual"),
        ),
        drift(have["canonical_md"] & ~is_indexed, "missing_index", F.lit("canonical_md is not indexed")),
    ]
    if chunks is not None:
        differs = (F.coalesce("c_count", F.lit(0)) != F.col("i_count")) | (
            F.coalesce("c_sum", F.lit(0)) != F.col("i_sum")
        )
        found.append(drift(is_indexed & differs, "stale_index", F.lit("index differs from the chunks")))
    drifts = entities.select(
        *ENTITY_KEY, F.explode(F.filter(F.array(*found), lambda d: d.isNotNull())).alias("_d")
    ).select(*ENTITY_KEY, "_d.*")
    extra = reps.filter(~F.col("rep_type").isin(*known)).select(
        *ENTITY_KEY, F.lit("extra_file").alias("drift_type"), F.col("rep_type").alias("detail")
    )
    return drifts.unionByName(extra.distinct())


def _fingerprint(chunks: DataFrame, prefix: str) -> DataFrame:
    """Row count and an order-free hash sum of an entity's chunks."""
    columns = [c for c in ("rep_name", "chunk_index", "text") if c in chunks.columns]
    # 32-bit parts keep the sum far from the 64-bit range.
    part = F.shiftrightunsigned(F.xxhash64(*columns), 32)
    return chunks.groupBy(*ENTITY_KEY).agg(
        F.count(F.lit(1)).alias(f"{prefix}_count"), F.sum(part).alias(f"{prefix}_sum")
    )


def repair_plan(drifts: DataFrame, sources: DataFrame) -> DataFrame:
    """``action`` and ``feasible`` per drift: rerun needs the source, resync does not,
    other drifts are only reported. A rerun raises the version by one."""
    has = sources.select(*ENTITY_KEY).distinct().withColumn("_source", F.lit(True))
    action = (
        F.when(F.col("drift_type").isin("stale_rep", "missing_rep"), F.lit("rerun"))
        .when(F.col("drift_type").isin("stale_index", "missing_index"), F.lit("resync"))
        .otherwise(F.lit("none"))
    )
    return (
        drifts.join(has, ENTITY_KEY, "left")
        .withColumn("action", action)
        .withColumn(
            "feasible",
            F.when(F.col("action") == "rerun", F.coalesce("_source", F.lit(False))).otherwise(
                F.col("action") == "resync"
            ),
        )
        .withColumn("version_bump", F.when((F.col("action") == "rerun") & F.col("feasible"), 1).otherwise(0))
        .drop("_source")
    )


def reconcile_report(dirs: DataFrame, plan: DataFrame) -> DataFrame:
    """Drifts, repairs and failures by type and in total; ``scanned`` in the total row."""
    failed = (F.col("action") != "none") & ~F.col("feasible")
    counted = plan.rollup("drift_type").agg(
        F.count(F.lit(1)).alias("drifts"),
        F.count_if(F.col("feasible")).alias("repaired"),
        F.count_if(failed).alias("errors"),
    )
    scanned = dirs.select(F.count_distinct(*ENTITY_KEY)).scalar()
    return counted.select(
        F.coalesce("drift_type", F.lit("total")).alias("drift_type"),
        F.when(F.col("drift_type").isNull(), scanned).otherwise(F.lit(0)).cast("long").alias("scanned"),
        "drifts", "repaired", "errors",
    )


def check_inheritance(reps: DataFrame, rules: DataFrame, pipeline_version: str | None = None) -> DataFrame:
    """Problems along the chain: a rep whose ``input_content_hash`` is not the current
    hash of its direct upstream, is missing its file, or has an old pipeline version."""
    keys = [c for c in ENTITY_KEY if c in reps.columns]
    edges = broadcast_if_small(rules.select(F.col("output_rep").alias("rep_type"), "input_rep").distinct(), SMALL_ROWS)
    upstream = reps.select(*keys, F.col("rep_type").alias("input_rep"), F.col("content_hash").alias("_up"))
    linked = reps.join(edges, "rep_type").join(upstream, [*keys, "input_rep"])
    # A rep may come from any of several inputs: it is in step if one of them fits.
    in_step = linked.groupBy(*keys, "rep_type").agg(
        F.bool_or(F.col("input_content_hash") == F.col("_up")).alias("_in_step")
    )
    checked = reps.join(in_step, [*keys, "rep_type"], "left")
    old = F.lit(False) if pipeline_version is None else F.coalesce(
        F.col("pipeline_version") != pipeline_version, F.lit(False)
    )
    problem = (
        F.when(F.col("content_hash").isNull(), F.lit("file_missing"))
        .when(~F.coalesce("_in_step", F.lit(True)), F.lit("input_changed"))
        .when(old & (F.col("rep_type") != "source_original"), F.lit("pipeline_changed"))
    )
    return checked.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_in_step")


def index_status(reps: DataFrame, built: DataFrame, required: list[str], model_version: str) -> DataFrame:
    """Freshness of each entity's index against its active reps.

    ``built`` has ``index_built_from_hash`` and ``model_version`` per entity.
    """
    keys = [c for c in ENTITY_KEY if c in reps.columns]
    ready = F.col("status") == "active"
    need = F.col("rep_type").isin(*required)
    state = reps.groupBy(*keys).agg(
        F.sha2(
            F.array_join(F.array_sort(F.collect_list(F.when(ready, F.col("content_hash")))), ""), 256
        ).alias("build_from_hash_set"),
        F.coalesce(F.bool_or(need & ~ready), F.lit(False)).alias("_wait"),
        F.coalesce(F.bool_or(~need & ~ready), F.lit(False)).alias("_partial"),
    )
    joined = state.join(built, keys, "left")
    same = (F.col("index_built_from_hash") == F.col("build_from_hash_set")) & (
        F.col("model_version") == model_version
    )
    return joined.select(
        *keys,
        "build_from_hash_set",
        F.when(F.col("index_built_from_hash").isNull(), F.lit("missing"))
        .when(same, F.lit("built")).otherwise(F.lit("stale")).alias("index_status"),
        F.when(F.coalesce(same, F.lit(False)), F.lit("skip"))
        .when(F.col("_wait"), F.lit("wait"))
        .when(F.col("_partial"), F.lit("partial"))
        .otherwise(F.lit("rebuild")).alias("action"),
    )


def audit_hashes(reps: DataFrame, content: str = "content", fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """Reps whose content does not have the recorded hash; a ``fraction`` of the
    entities is checked, chosen by a hash of their key."""
    keys = [c for c in ENTITY_KEY if c in reps.columns]
    chosen = reps
    if fraction < 1.0:
        chosen = reps.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(10_000)) < int(fraction * 10_000))
    return chosen.withColumn("actual_hash", hash16(F.col(content))).filter(
        ~F.col("actual_hash").eqNullSafe(F.col("content_hash"))
    ).drop(content)


def rebuild_metadata(files: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rep and entity rows from files alone (``scan_corpus`` with contents).

    Input hashes come from the upstream rep by the rules; everything is ``stale``
    until a rebuild confirms it.
    """
    hashed = files.select(*ENTITY_KEY, "rep_type", hash16(F.col("content")).alias("content_hash"), "size")
    edges = broadcast_if_small(rules.select("step", F.col("output_rep").alias("rep_type"), "input_rep"), SMALL_ROWS)
    upstream = hashed.select(*ENTITY_KEY, F.col("rep_type").alias("input_rep"), F.col("content_hash").alias("input_content_hash"))
    derived = (
        hashed.join(edges, "rep_type").join(upstream, [*ENTITY_KEY, "input_rep"])
        .groupBy(*ENTITY_KEY, "rep_type")
        .agg(F.min(F.struct(F.col("step").alias("transform"), "input_content_hash")).alias("_in"))
        .select(*ENTITY_KEY, "rep_type", "_in.*")
    )
    reps = hashed.join(derived, [*ENTITY_KEY, "rep_type"], "left").withColumn("status", F.lit("stale"))
    entities = hashed.filter("rep_type = 'source_original'").select(
        *ENTITY_KEY, "content_hash", F.lit("document").alias("entity_type"), F.col("entity_id").alias("name"),
        F.lit(1).alias("version"), F.lit("stale").alias("status"),
    )
    return reps, entities


# --- versions ------------------------------------------------------------------------


def publish(index: DataFrame, published: DataFrame) -> DataFrame:
    """Mark the rows of each entity's published version active, the others not.

    ``published`` has one ``version`` per entity: the newest that was published,
    so the old rows stay active until the switch.
    """
    keys = entity_key(index, published)
    latest = published.groupBy(*keys).agg(F.max("version").alias("_live"))
    return index.join(latest, keys, "left").withColumn(
        "active", F.coalesce(F.col("version") == F.col("_live"), F.lit(False))
    ).drop("_live")


def as_of(log: DataFrame, when: Column | None = None, version: int | None = None) -> DataFrame:
    """The latest log state per entity up to a time or a version."""
    chosen = log
    if when is not None:
        chosen = chosen.filter(F.col("timestamp") <= when)
    if version is not None:
        chosen = chosen.filter(F.col("version") <= version)
    keys = entity_key(log)
    rest = [c for c in log.columns if c not in keys]
    return chosen.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("timestamp", "version")).alias("_s")
    ).select(*keys, "_s.*")


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change classes between two snapshots with one row per (entity, scope, name), entities
    named with workspace and collection where the snapshots have them.

    Scopes are ``raw``, ``rep``, ``index``, ``schema``, ``entity`` and
    ``projector``; ``content_hash`` and ``status`` hold their state.
    """
    key = [*entity_key(old, new), "scope", "name"]
    a = old.select(*key, F.col("content_hash").alias("h0"), F.col("status").alias("s0"), F.lit(True).alias("in0"))
    b = new.select(*key, F.col("content_hash").alias("h1"), F.col("status").alias("s1"), F.lit(True).alias("in1"))
    both = a.join(b, key, "full_outer")
    content = ~F.col("h0").eqNullSafe(F.col("h1"))
    state = ~F.col("s0").eqNullSafe(F.col("s1"))
    kind = (
        F.when((F.col("scope") == "raw") & content, F.lit("C1"))
        .when((F.col("scope") == "rep") & content, F.lit("C2"))
        .when((F.col("scope") == "rep") & state, F.lit("C3"))
        .when((F.col("scope") == "index") & (content | state), F.lit("C4"))
        .when((F.col("scope") == "schema") & (content | state), F.lit("C5"))
        .when((F.col("scope") == "entity") & (content | state), F.lit("C6"))
        .when((F.col("scope") == "projector") & (content | state), F.lit("C7"))
    )
    return both.withColumn("change", kind).filter(F.col("change").isNotNull()).select(*key, "change")


# --- edges -----------------------------------------------------------------------------


def edge_status(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """An edge is deleted or stale as soon as one of its ends is. Its ends lie in its own
    workspace and collection; an edge is one row, however often an end is listed."""
    scope = _edge_scope(edges, entities)
    ends = entities.filter(F.col("status").isin("deleted", "stale")).groupBy(*scope, "entity_id")
    ends = ends.agg(F.min("status").alias("_status"))  # deleted comes first
    src = ends.select(*scope, F.col("entity_id").alias("src"), F.col("_status").alias("_s"))
    dst = ends.select(*scope, F.col("entity_id").alias("dst"), F.col("_status").alias("_d"))
    joined = edges.join(src, [*scope, "src"], "left").join(dst, [*scope, "dst"], "left")
    either = F.array("_s", "_d")
    return joined.withColumn(
        "status",
        F.when(F.array_contains(either, "deleted"), F.lit("deleted"))
        .when(F.array_contains(either, "stale"), F.lit("stale"))
        .otherwise(F.lit("active")),
    ).drop("_s", "_d")


def _edge_scope(edges: DataFrame, entities: DataFrame) -> list[str]:
    """Workspace and collection of edges; both tables have them, or neither has."""
    scope = [c for c in ENTITY_KEY if c != "entity_id" and c in edges.columns]
    if [*scope, "entity_id"] != [c for c in ENTITY_KEY if c in entities.columns]:
        raise ValueError("edges and entities name workspace and collection differently")
    return scope


def neighbors(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Entities within ``hops`` of the seeds along edges in both directions, with the
    shortest distance; paths stay in the workspace and collection of their edges. Every hop
    is stored before the next one is planned."""
    scope = _edge_scope(edges, seeds)
    both = edges.select(*scope, F.col("src").alias("entity_id"), "dst").unionByName(
        edges.select(*scope, F.col("dst").alias("entity_id"), F.col("src").alias("dst"))
    ).distinct()
    key = [*scope, "entity_id"]
    seen = seeds.select(*key).distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(both, key).select(*scope, F.col("dst").alias("entity_id")).distinct()
        frontier = durable(reached.join(seen, key, "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


# --- upkeep ------------------------------------------------------------------------------


def rebuild_priority(entities: DataFrame, now: Column) -> DataFrame:
    """``high``, ``medium`` or ``low`` by the age of the last search that hit it."""
    days = F.date_diff(F.to_date(now), F.to_date("last_searched"))
    return entities.withColumn(
        "priority",
        F.when((days <= 7) & (F.col("status") == "enabled"), F.lit("high"))
        .when(days <= 30, F.lit("medium"))
        .otherwise(F.lit("low")),
    )


def purge(entities: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Entities to keep, and those soft-deleted more than ``days`` days ago."""
    old = (F.col("status") == "deleted") & (F.col("updated_at") < now - F.make_interval(days=F.lit(days)))
    doomed = F.coalesce(old, F.lit(False))
    return entities.filter(~doomed), entities.filter(doomed)


def missing_entities(files: DataFrame, entities: DataFrame, on: str = "source_uri") -> DataFrame:
    """Listed files without an entity: their events were missed."""
    return files.join(entities.select(on).distinct(), on, "left_anti")


def orphaned_entities(entities: DataFrame, files: DataFrame, on: str = "source_uri") -> DataFrame:
    """Entities whose recorded source is no longer listed."""
    return entities.filter(F.col(on).isNotNull()).join(files.select(on).distinct(), on, "left_anti")

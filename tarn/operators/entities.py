"""Per-entity projections, filters, routing and updates over whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.located import FILE, ROW, at_places, is_located
from tarn.functions.sizes import broadcast_if_small, is_small
from tarn.functions.text import decode_text, file_extension, hash16
from tarn.schema import REP_DIMS

# --- fixed values: output formats by modality ------------------------------------
MODALITY_FORMATS = {
    "image": ("png", "jpg", "jpeg", "tiff", "bmp", "gif", "webp", "svg", "heic", "avif"),
    "audio": ("wav", "mp3", "flac", "ogg", "m4a", "opus"),
    "video": ("mp4", "avi", "mov", "mkv", "webm", "flv", "wmv"),
    "table": ("csv", "tsv", "xlsx", "xls", "parquet"),
}

# Watch rules that are looked up in the row.
MAP_RULES = 200

ENTITY_KEY = ["workspace_id", "collection_id", "entity_id"]


def entity_key(*tables: DataFrame) -> list[str]:
    """The columns that name an entity in all of ``tables``.

    Ids are hashes of contents, so two collections that hold one file share its id. Tables
    of a single collection may leave the scope out, but then all have to: a join by the
    bare id would reach into other collections.
    """
    named = [[c for c in ENTITY_KEY if c in t.columns] for t in tables]
    if any(names != named[0] for names in named):
        raise ValueError(f"tables name entities by different columns: {named}")
    return named[0]


# --- content addressing -----------------------------------------------------------


def with_content_id(df: DataFrame, content: str = "content") -> DataFrame:
    """``content_hash`` and ``entity_id`` from the bytes."""
    hashed = df.withColumn("content_hash", hash16(F.col(content)))
    return hashed.withColumn("entity_id", F.concat(F.lit("ent_"), F.col("content_hash")))


def dedup_by_content(df: DataFrame, order: str, keys: Sequence[str] = ENTITY_KEY) -> DataFrame:
    """One row per entity; of identical contents the last write wins. A null order is
    earlier than any other.

    An aggregate rather than a ranked window: copies collapse in each map task,
    so a content that makes up much of the input does not travel. Of rows with places
    (``functions/located.py``) only keys, order and places travel, contents stay in their
    files and the last writes are read again; places also settle equal orders.
    """
    if is_located(df):
        place, written = F.struct(FILE, ROW), F.col(order)
        last = df.groupBy(*keys).agg(F.max_by(place, F.struct(written.isNotNull(), written, FILE, ROW)).alias("_last"))
        kept = at_places(df, last.select("_last.*"))
        return kept.select(*keys, *[c for c in kept.columns if c not in keys])
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_last"))
        .select(*keys, "_last.*")
    )


def decoded(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    return df.withColumn(out, decode_text(F.col(content)))


def parse_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """JSON text to a string map; text that is not a JSON object gives an empty map."""
    parsed = F.from_json(F.col(column), "map<string,string>", {"mode": "PERMISSIVE"})
    return df.withColumn(column, F.coalesce(parsed, F.create_map().cast("map<string,string>")))


def encode_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def new_entities(df: DataFrame, now: Column) -> DataFrame:
    """Entity rows for uploaded files (``workspace_id, collection_id, name, content``)."""
    return (
        with_content_id(df)
        .withColumn("entity_type", F.lit("document"))
        .withColumn("source_type", F.lit("oss"))
        .withColumn(
            "source_uri",
            F.concat_ws("/", "workspace_id", "collection_id", "entity_id", F.lit("source/original")),
        )
        .withColumn("version", F.lit(1))
        .withColumn("status", F.lit("enabled"))
        .withColumn("labels", F.array().cast("array<string>"))
        .withColumn("model_version", F.lit(""))
        .withColumn("created_at", now)
        .withColumn("updated_at", now)
    )


# --- routing ------------------------------------------------------------------------


def route_files(df: DataFrame, routes: DataFrame, name: str = "name") -> DataFrame:
    """``ext``, ``format`` and ``entity_type`` by extension.

    An unmapped extension is its own format; without an extension there is none.
    ``routes`` is the extension table, by default a fixed one of some fifty rows.
    """
    known = routes.withColumnRenamed("format", "_format")
    return (
        df.withColumn("ext", file_extension(F.col(name)))
        .join(broadcast_if_small(known, MAP_RULES), "ext", "left")
        .withColumn("format", F.coalesce("_format", F.nullif(F.expr("substr(ext, 2)"), F.lit(""))))
        .drop("_format")
    )


def split_supported(df: DataFrame, routes: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Files of a type that can be ingested, and the others with a message."""
    routed = route_files(df, routes, name)
    supported = F.col("entity_type").isNotNull()
    message = F.concat(
        F.lit("Unsupported file type: "),
        F.when(F.col("ext") == "", F.lit("(none)")).otherwise(F.col("ext")),
    )
    return routed.filter(supported), routed.filter(~supported).withColumn("reason", message)


def modality_of(output_format: Column) -> Column:
    """Modality of an output format, ``text`` unless listed."""
    found = F.lit("text")
    for modality, formats in MODALITY_FORMATS.items():
        found = F.when(output_format.isin(*formats), F.lit(modality)).otherwise(found)
    return found


def url_entities(df: DataFrame, strategy: str = "url_hash", order: str = "seq", url: str = "url",
                 template: str = "{domain}/{path}") -> DataFrame:
    """One entity per URL without its fragment; the last fetch wins. Bodies of rows with places
    are not shuffled, see :func:`dedup_by_content`."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.coalesce(F.try_parse_url(bare, F.lit("HOST")), F.lit(""))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(bare, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    if strategy == "url_hash":
        key = hash16(bare)
    elif strategy == "url_path":
        key = F.concat_ws("/", host, F.nullif(path, F.lit("")))
    elif strategy == "template":
        key = F.replace(F.replace(F.lit(template), F.lit("{domain}"), host), F.lit("{path}"), path)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return dedup_by_content(df.withColumn("entity_id", key), order, ["entity_id"])


def chunk_id(entity: Column, rep: Column, index: Column) -> Column:
    return F.concat_ws("/", entity, rep, F.concat(F.lit("#"), index.cast("string")))


def parse_chunk_id(col: Column) -> Column:
    """``struct<entity_id, rep_type, chunk_index>``, null if it is not a chunk id."""
    pattern = "^(.+)/([^/]+)/#([0-9]+)$"
    return F.when(
        F.regexp_like(col, F.lit(pattern)),
        F.struct(
            F.regexp_extract(col, pattern, 1).alias("entity_id"),
            F.regexp_extract(col, pattern, 2).alias("rep_type"),
            F.regexp_extract(col, pattern, 3).cast("long").alias("chunk_index"),
        ),
    )


def match_rules(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Each file with the rule of the longest ``prefix`` of its path (or none).

    Only prefixes of a length some rule has are looked up. A rule set of up to
    ``MAP_RULES`` rules travels as a map and is looked up in the row; a larger one
    is joined on the prefix text. Files are never paired with rules that differ.
    """
    lengths = rules.agg(F.reverse(F.array_sort(F.collect_set(F.length("prefix"))))).scalar()
    if is_small(rules, MAP_RULES):
        table = rules.groupBy("prefix").agg(F.max("rule").alias("rule")).agg(
            F.map_from_entries(F.collect_list(F.struct("prefix", "rule")))
        ).scalar()
        held = files.withColumn("_lengths", lengths).withColumn("_rules", table)
        hits = F.filter(
            F.transform(
                F.filter("_lengths", lambda n: n <= F.length(path)),
                lambda n: F.try_element_at("_rules", F.substring(F.col(path), F.lit(1), n)),
            ),
            lambda r: r.isNotNull(),
        )
        return held.withColumn("rule", F.get(hits, F.lit(0))).drop("_lengths", "_rules")
    probes = (
        files.select(path).distinct()
        .select(path, F.explode(lengths).alias("_n"))
        .filter(F.col("_n") <= F.length(path))
        .withColumn("prefix", F.expr(f"substr({path}, 1, _n)"))
    )
    best = (
        probes.join(rules, "prefix")
        .groupBy(path)
        .agg(F.max_by("rule", F.struct(F.length("prefix"), F.col("rule"))).alias("rule"))
    )
    return files.join(best, path, "left")


# --- listing and checks ----------------------------------------------------------------


def list_entities(df: DataFrame, status: str | None = None) -> DataFrame:
    chosen = df if status is None else df.filter(F.col("status") == status)
    return chosen.orderBy("entity_id")


def get_entities(df: DataFrame, ids: DataFrame) -> DataFrame:
    keys = entity_key(df, ids)
    return df.join(ids.select(*keys).distinct(), keys, "left_semi")


def id_problem(col: Column) -> Column:
    """Why an identifier is refused, or null."""
    return (
        F.when(col.isNull() | (col == ""), F.lit("empty"))
        .when(
            F.contains(col, F.lit("..")) | F.contains(col, F.lit("/")) | F.contains(col, F.lit("\\")),
            F.lit("path characters"),
        )
        .when(~F.regexp_like(col, F.lit("\\A[a-zA-Z0-9_.-]+\\z")), F.lit("characters not allowed"))
    )


def validate_ids(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a safe identifier, and the others with a reason."""
    checked = df.withColumn("reason", id_problem(F.col(column)))
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def path_under_root(path: Column, root: str) -> Column:
    """Whether a normalised path stays below ``root``."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~F.regexp_like(
        path, F.lit("(^|/)\\.\\.(/|$)")
    )


def filter_files(df: DataFrame, extensions: Sequence[str], max_mb: float,
                 blocked: Sequence[str] = (), name: str = "name", size: str = "length") -> DataFrame:
    """Files a watch accepts: listed extension, size limit, no blocked name pattern."""
    from tarn.functions.text import fnmatch_regex

    most = max_mb * 1024 * 1024
    # A whole number is compared by Spark's file reader, which does not open larger files then.
    keep = F.col(size) <= (math.floor(most) if math.isfinite(most) else most)
    if extensions:
        keep = keep & file_extension(F.col(name)).isin(*[e.lower() for e in extensions])
    for pattern in blocked:
        keep = keep & ~F.regexp_like(name, F.lit(fnmatch_regex(pattern)))
    return df.filter(keep)


def event_history(df: DataFrame, event_type: str | None, n: int) -> DataFrame:
    """The latest ``n`` events (of one type, or overall) in time order."""
    chosen = df if event_type is None else df.filter(F.col("event_type") == event_type)
    return chosen.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")


def event_history_by_type(df: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` events of every type, newest rank first.

    The rank filter is cut to ``n`` per type in every map task before the shuffle.
    """
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


# --- updates ----------------------------------------------------------------------------


def patch_entities(entities: DataFrame, patches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply new ``status`` and ``labels`` where given; returns entities and log rows.

    ``patches`` has one row per entity; the version does not change.
    """
    keys = entity_key(entities, patches)
    given = patches.select(
        *keys, F.col("status").alias("_status"), F.col("labels").alias("_labels"), F.lit(True).alias("_hit")
    )
    joined = entities.join(given, keys, "left")
    updated = (
        joined.withColumn("status", F.coalesce("_status", "status"))
        .withColumn("labels", F.coalesce("_labels", "labels"))
        .withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    )
    log = updated.filter(F.col("_hit")).select(
        *keys, "version", "content_hash", now.alias("timestamp"), F.lit("update").alias("trigger")
    )
    return updated.drop("_status", "_labels", "_hit"), log


def update_content(entities: DataFrame, contents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New contents for existing entities: new hash and ``version + 1``.

    Returns entities, log rows, and the changed reps that feed the stale cascade.
    """
    keys = entity_key(entities, contents)
    hashed = contents.select(*keys, hash16(F.col("content")).alias("_hash"))
    joined = entities.join(hashed, keys, "left")
    changed = F.col("_hash").isNotNull() & (F.col("_hash") != F.col("content_hash"))
    updated = (
        joined.withColumn("_changed", F.coalesce(changed, F.lit(False)))
        .withColumn("version", F.when(F.col("_changed"), F.col("version") + 1).otherwise(F.col("version")))
        .withColumn("content_hash", F.when(F.col("_changed"), F.col("_hash")).otherwise(F.col("content_hash")))
        .withColumn("updated_at", F.when(F.col("_changed"), now).otherwise(F.col("updated_at")))
    )
    touched = updated.filter("_changed")
    log = touched.select(
        *keys, "version", "content_hash", now.alias("timestamp"),
        F.lit("content_update").alias("trigger"),
    )
    reps = touched.select(*keys, F.lit("source_original").alias("rep_type"))
    return updated.drop("_hash", "_changed"), log, reps


def delete_entities(entities: DataFrame, ids: DataFrame, now: Column, hard: bool = False) -> DataFrame:
    """Soft delete sets the status, hard delete removes the rows."""
    keys = entity_key(entities, ids)
    doomed = ids.select(*keys).distinct()
    if hard:
        return entities.join(doomed, keys, "left_anti")
    marked = entities.join(doomed.withColumn("_hit", F.lit(True)), keys, "left")
    return (
        marked.withColumn("status", F.when(F.col("_hit"), F.lit("deleted")).otherwise(F.col("status")))
        .withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
        .drop("_hit")
    )


def drop_collections(rows: DataFrame, doomed: DataFrame, watches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the rows of collections, unless an active watch points at one.

    Returns the remaining rows and the refused collections.
    """
    keys = ["workspace_id", "collection_id"]
    active = watches.filter(F.col("status") == "active").select(*keys).distinct()
    refused = doomed.join(active, keys, "left_semi")
    return rows.join(doomed.join(active, keys, "left_anti"), keys, "left_anti"), refused


# --- counts and status --------------------------------------------------------------------


def workspace_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("workspace_id").agg(F.count_distinct("collection_id").alias("collection_count"))


def collection_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("workspace_id", "collection_id").agg(
        F.count_distinct("entity_id").alias("entity_count")
    )


def chunk_counts(entities: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks per entity, zero included."""
    keys = entity_key(entities, index)
    counted = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"))
    return entities.select(*keys).join(counted, keys, "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long"))
    )


def reps_by_type(reps: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per entity with a struct column ``_{rep_type}`` per known rep type.

    The types are a fixed list, so this is a plain aggregate with partial results
    and no collected list, however many files an entity has.
    """
    return reps.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("rep_type") == rep, F.struct(*fields))).alias(f"_{rep}")
            for rep, *_ in REP_DIMS
        ]
    )


def pipeline_status(entities: DataFrame, reps: DataFrame, index: DataFrame) -> DataFrame:
    """Per entity: which of the known reps exist, the stage reached and index state."""
    keys = entity_key(entities, reps, index)
    present = reps_by_type(reps, keys, ["content_hash", "transform", "status"])
    joined = entities.join(present, keys, "left").join(chunk_counts(entities, index), keys, "left")

    def rep(name: str) -> Column:
        found = F.col(f"_{name}")
        return F.struct(
            F.lit(name).alias("rep_type"),
            found.isNotNull().alias("exists"),
            F.coalesce(found["content_hash"], F.lit("")).alias("content_hash"),
            (F.coalesce(found["status"], F.lit("")) == "active").alias("indexed"),
            F.coalesce(found["transform"], F.lit("")).alias("source_step"),
        )

    matrix = F.array(*[rep(name) for name, *_ in REP_DIMS])
    source = F.col("_source_original").isNotNull()
    canonical = F.col("_canonical_md").isNotNull()
    stage = (
        F.when(source & canonical, F.lit("completed"))
        .when(source, F.lit("processing"))
        .otherwise(F.lit("pending"))
    )
    return joined.select(
        "entity_id",
        F.col("status").alias("entity_status"),
        matrix.alias("reps"),
        "chunk_count",
        (F.col("chunk_count") > 0).alias("indexed"),
        stage.alias("pipeline_stage"),
    )


def quota_report(entities: DataFrame, index: DataFrame, quotas: DataFrame) -> DataFrame:
    """Entities, chunks and stored bytes per collection against their limits."""
    keys = ["workspace_id", "collection_id"]
    chunks = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"))
    used = entities.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("size").alias("storage")
    )
    joined = used.join(chunks, keys, "left").join(quotas, keys, "left")
    return joined.withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long"))).withColumn(
        "exceeded",
        F.coalesce(F.col("entities") > F.col("max_entities"), F.lit(False))
        | F.coalesce(F.col("chunks") > F.col("max_chunks"), F.lit(False))
        | F.coalesce(F.col("storage") > F.col("max_storage"), F.lit(False)),
    )

"""The corpus as a virtual file tree: ls, stat, read, glob and grep as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.arrays import explode_rows, indexes
from tarn.functions.regex import literals, parse, to_java
from tarn.functions.sizes import broadcast_if_small
from tarn.functions.text import fnmatch_regex, split_lines
from tarn.operators.text_index import TextIndex, texts_with, write_text_index
from tarn.schema import TEXT_REPS, VIRTUAL_NAMES

SCOPE = ["workspace_id", "collection_id"]


def virtual_name(rep_type: Column) -> Column:
    name = rep_type
    for rep, shown in VIRTUAL_NAMES.items():
        name = F.when(rep_type == rep, F.lit(shown)).otherwise(name)
    return name


def vfs_tree(entities: DataFrame, reps: DataFrame) -> DataFrame:
    """One directory row per entity and one file row per rep; of entities with the
    same name in a collection the later id takes the path.

    Rep contents stay out of the tree and join back by entity and rep.
    """
    meta = ["entity_type", "name", "status", "content_hash", "version", "labels"]
    named = entities.select(*SCOPE, "entity_id", *meta).withColumn(
        "_name", F.when(F.coalesce("name", F.lit("")) == "", F.col("entity_id")).otherwise(F.col("name"))
    )
    dirs = named.select(
        *SCOPE, F.concat(F.lit("/"), "_name").alias("path"), F.lit("dir").alias("type"), "entity_id",
        F.lit(None).cast("string").alias("rep_type"), F.lit(0).cast("long").alias("size"), *meta,
    )
    files = named.join(reps.select(*SCOPE, "entity_id", "rep_type", "size"), [*SCOPE, "entity_id"]).select(
        *SCOPE, F.concat_ws("/", F.lit(""), "_name", virtual_name(F.col("rep_type"))).alias("path"),
        F.lit("file").alias("type"), "entity_id", "rep_type", F.col("size").cast("long").alias("size"), *meta,
    )
    rest = ["type", "entity_id", "rep_type", "size", *meta]
    return (
        dirs.unionByName(files).groupBy(*SCOPE, "path")
        .agg(F.max_by(F.struct(*rest), F.struct("entity_id", "type")).alias("_e"))
        .select(*SCOPE, "path", "_e.*")
    )


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def vfs_ls(tree: DataFrame, path: str = "/") -> DataFrame:
    """Entity directories below ``/``, else the direct children of a path."""
    path = path.rstrip("/") or "/"
    if path == "/":
        found = tree.filter((F.col("type") == "dir") & (_slashes(F.col("path")) == 1))
        return found.withColumn("entry", F.expr("substr(path, 2)"))
    found = tree.filter(
        F.startswith("path", F.lit(path + "/")) & (_slashes(F.col("path")) == path.count("/") + 1)
    )
    return found.withColumn("entry", F.substring(F.col("path"), F.lit(len(path) + 2), F.length("path")))


def _normalised(paths: DataFrame) -> DataFrame:
    bare = F.regexp_replace("path", "/+$", "")
    return paths.withColumn("path", F.when(bare == "", F.lit("/")).otherwise(bare)).distinct()


def vfs_stat(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """Tree rows of the given paths; unknown paths give no row."""
    on = [c for c in (*SCOPE, "path") if c in paths.columns]
    return tree.join(_normalised(paths.select(*on)), on)


def vfs_read(tree: DataFrame, reps: DataFrame, paths: DataFrame) -> DataFrame:
    """Path, entity, rep and content of the given file paths; directories give none."""
    wanted = vfs_stat(tree, paths).filter(F.col("type") == "file").select(*SCOPE, "path", "entity_id", "rep_type")
    return reps.select(*SCOPE, "entity_id", "rep_type", "content").join(
        broadcast_if_small(wanted, 500_000), [*SCOPE, "entity_id", "rep_type"]
    )


def vfs_glob(tree: DataFrame, pattern: str) -> DataFrame:
    """Paths that match a shell pattern as a whole; wildcards cross ``/``."""
    return tree.filter(F.regexp_like("path", F.lit(fnmatch_regex(pattern))))


def write_grep_index(reps: DataFrame, path: str) -> None:
    """A text index of the text reps, for :func:`vfs_grep`."""
    texts = reps.where(F.col("rep_type").isin(*TEXT_REPS)).withColumnRenamed("content", "text")
    write_text_index(texts, path, [*SCOPE, "entity_id", "rep_type"])


def vfs_grep(tree: DataFrame, reps: DataFrame | TextIndex, pattern: str, prefix: str = "/", context: int = 2,
             limit: int = 50) -> DataFrame:
    """Lines of text reps that match a case-insensitive regex, with line numbers and
    neighbouring lines; the first ``limit`` in path order.

    Lines of a rep stay an array, so its context needs no window over lines, and
    contents are searched where they lie: only matches meet the tree. With a written
    index for ``reps`` only the reps are read that hold the trigrams of a literal string
    of the pattern.

    The pattern is one of Python's. An invalid one matches nothing; one that Spark's regular
    expressions cannot say is refused by name.
    """
    prefix = prefix.rstrip("/") or "/"
    parsed = parse(pattern)
    texts = tree.filter((F.col("type") == "file") & F.col("rep_type").isin(*TEXT_REPS))
    if prefix != "/":
        texts = texts.filter(F.startswith("path", F.lit(prefix)))
    if parsed is None:
        texts = texts.filter(F.lit(False))
    regex = F.lit("" if parsed is None else to_java(parsed))
    wanted = texts.select(*SCOPE, "path", "entity_id", "rep_type", "entity_type", "name")
    if isinstance(reps, TextIndex):
        clauses = [] if parsed is None else literals(parsed)
        reps = texts_with(reps, clauses).withColumnRenamed("text", "content")
    key = [*SCOPE, "entity_id", "rep_type"]
    candidates = reps.select(*key, "content").filter(F.col("rep_type").isin(*TEXT_REPS))
    if prefix != "/":
        candidates = candidates.join(broadcast_if_small(wanted.select(*key), 500_000), key, "left_semi")
    lined = candidates.withColumn("_lines", split_lines(F.col("content")))

    def with_context(z: Column) -> Column:
        start = F.greatest(z["i"] - context, F.lit(0))
        return F.struct(
            (z["i"] + 1).cast("long").alias("line_number"),
            z["line"].alias("line_text"),
            F.slice("_lines", start + 1, z["i"] - start).alias("context_before"),
            F.slice("_lines", z["i"] + 2, F.lit(context)).alias("context_after"),
        )

    numbered = F.arrays_zip(F.col("_lines").alias("line"), indexes(F.col("_lines")).alias("i"))
    hits = F.transform(F.filter(numbered, lambda z: F.regexp_like(z["line"], regex)), with_context)
    matches = explode_rows(lined, key, hits, "_n", "_m").select(*key, "_m.*")
    found = matches.join(wanted, key).withColumnRenamed("path", "file_path")
    return found.orderBy(*SCOPE, "file_path", "line_number").limit(limit)

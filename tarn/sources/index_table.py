"""The chunk index as a partitioned table that is merged when it is read.

A row lies in the partition of its workspace, collection, rep and shard, and there in the base
(``delta=0``) or in one of the deltas that syncs append. The last delta that names an (entity,
rep) replaces all earlier rows of it; a row without a chunk number says that it has none left.
``compact_index`` folds the deltas into the base.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.functions.sizes import broadcast_if_small
from tarn.session import durable, scratch

# Shards differ in number from table to table, so the number is part of the path.
PLACE = ["workspace_id", "collection_id", "rep_name", "shards", "shard"]
PARTITIONS = [*PLACE, "delta"]
REP_KEY = ["workspace_id", "collection_id", "entity_id", "rep_name"]
#: Rows of one rep of a collection that a shard is meant for, and shards at most.
SHARD_ROWS, MOST_SHARDS = 200_000, 4096
# Keys of deltas that are broadcast to readers.
SMALL_KEYS = 500_000


def _shard(entity: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(entity), shards).cast("int")


def with_shard(df: DataFrame, shards: int) -> DataFrame:
    """A hash shard of the entity: partitions stay few and of even size, where one
    directory per entity would mean millions of small files."""
    number = F.lit(shards).cast("int")
    return df.withColumn("shards", number).withColumn("shard", _shard(F.col("entity_id"), number))


def stored_shards(spark: SparkSession, path: str) -> int | None:
    """The number of shards a written index has; none where nothing is written."""
    try:
        row = spark.read.parquet(path).select("shards").head()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return row["shards"] if row else None


def _agreed_shards(spark: SparkSession, path: str, asked: int | None) -> int | None:
    stored = stored_shards(spark, path)
    if stored and asked and stored != asked:
        raise ValueError(f"{path} is written in {stored} shards, not {asked}")
    return stored or asked


def _shards_for(rows: DataFrame) -> int:
    """By the size of the largest collection and rep."""
    largest = rows.groupBy(*PLACE[:3]).count().agg(F.max("count")).first()[0] or 0
    return min(max(1, -(-largest // SHARD_ROWS)), MOST_SHARDS)


def _write(placed: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        placed.hint("rebalance", *PARTITIONS)
        .sortWithinPartitions(*PARTITIONS, "entity_id", "chunk_index")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS).parquet(path)
    )


def _delta_files(index: DataFrame) -> list[str]:
    return [f for f in index.inputFiles() if re.search(r"/delta=[1-9]", f)]


def write_chunk_index(df: DataFrame, path: str, shards: int | None = None, mode: str = "overwrite") -> None:
    """Write (or replace) an index. Rows are rebalanced by the table layout: Spark
    splits a large partition over several files and merges small ones, and the
    rows, with vectors that are costly to make, are computed once.

    A table keeps the number of shards it was first written with; without one it
    follows from the number of rows. Deltas of partitions that are replaced go."""
    spark = df.sparkSession
    with scratch(spark):
        agreed = _agreed_shards(spark, path, shards)
        stale = _delta_files(spark.read.parquet(path)) if mode == "overwrite" and stored_shards(spark, path) else []
        if stale or not agreed:
            df = durable(df)
        placed = with_shard(df, agreed or _shards_for(df)).withColumn("delta", F.lit(0))
        _write(placed, path, mode)
        if stale:
            written = {r["name"] for r in placed.select(_place_name().alias("name")).distinct().collect()}
            _delete_files(spark, [f for f in stale if _place_of(f) in written])


def read_chunk_index(spark: SparkSession, path: str, workspace: str | None = None,
                     collection: str | None = None, rep: str | None = None,
                     entity: str | None = None) -> DataFrame:
    """The index, cut to the asked partitions; an entity opens one shard."""
    index = spark.read.parquet(path)
    for column, value in (("workspace_id", workspace), ("collection_id", collection), ("rep_name", rep)):
        if value is not None:
            index = index.filter(F.col(column) == value)
    if entity is not None:
        shard = _shard(F.lit(entity), F.col("shards"))
        index = index.filter((F.col("shard") == shard) & (F.col("entity_id") == entity))
    return _merged(index).drop("shards", "shard")


def _merged(index: DataFrame) -> DataFrame:
    """The rows that count. Without deltas the base as it is; else the keys of the deltas
    meet both, and no row of the base moves where these keys can be broadcast."""
    base = index.filter("delta = 0").drop("delta")
    if not _delta_files(index):
        return base
    deltas = index.filter("delta > 0")
    newest = broadcast_if_small(durable(deltas.groupBy(*REP_KEY).agg(F.max("delta").alias("delta"))), SMALL_KEYS)
    last = deltas.filter("chunk_index is not null").join(newest, [*REP_KEY, "delta"], "left_semi").drop("delta")
    return base.join(newest.drop("delta"), REP_KEY, "left_anti").unionByName(last)


def latest_reps(rows: DataFrame, order: str) -> DataFrame:
    """The rows of the latest version of every (entity, rep), by the column ``order``.

    A version without an order is older than the others. A version that arrived twice
    counts once: one row for each chunk.
    """
    newest = rows.groupBy(*REP_KEY).agg(F.max(order).alias("_newest"))
    named = newest.select(*[F.col(k).alias(f"_{k}") for k in REP_KEY], "_newest")
    same = F.col(order).eqNullSafe(F.col("_newest"))
    for k in REP_KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    once = [*REP_KEY, "chunk_index"] if "chunk_index" in rows.columns else REP_KEY
    return rows.join(named, same, "left_semi").dropDuplicates(once)


def replace_reps(target: DataFrame, staged: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``target`` with every (entity, rep) found in ``staged`` replaced by it.

    ``touched`` are the keys of ``staged`` where the caller has them at hand.
    """
    keys = [k for k in REP_KEY if k in staged.columns and k in target.columns]
    if touched is None:
        touched = staged.select(*keys).distinct()
    return target.join(touched, keys, "left_anti").unionByName(staged, allowMissingColumns=True)


def _place_name() -> Column:
    """As the folders of a file spell the partition."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in PLACE])


def _place_of(file: str) -> str:
    from urllib.parse import unquote

    # The URI quotes the name that the writer has quoted already.
    found = re.search(r"/(workspace_id=.*)/delta=", unquote(unquote(file)))
    return found.group(1) if found else ""


def _delete_files(spark: SparkSession, files: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for file in files:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        where.getFileSystem(hadoop).delete(where, False)


def sync_index(spark: SparkSession, path: str, staged: DataFrame, order: str | None = None,
               touched: DataFrame | None = None) -> int:
    """Bring staged chunks into a written index and return their number.

    Where the rows may hold several versions of a rep, ``order`` names the column
    that tells the latest. ``touched`` are the (entity, rep) keys that were chunked:
    those among them without a row in ``staged`` are emptied. The rows of ``staged``
    count as touched in any case.

    Only the batch is written, as a delta beside what is there, which is not read.
    Running it again with the same rows changes nothing that readers see. One sync
    at a time writes to an index.
    """
    with scratch(spark):
        shards = _agreed_shards(spark, path, None)
        if shards is None:
            raise ValueError(f"no index is written at {path}")
        index = spark.read.parquet(path)
        rows = latest_reps(staged, order) if order else staged
        if order and order not in index.columns:
            rows = rows.drop(order)
        fresh = durable(rows)
        missing = [f for f in index.schema.fields if f.name not in (*fresh.columns, *PARTITIONS)]
        batch = fresh.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
        if touched is not None:
            gone = touched.select(*REP_KEY).distinct().join(fresh.select(*REP_KEY).distinct(), REP_KEY, "left_anti")
            batch = batch.unionByName(gone, allowMissingColumns=True)
        last = max((int(n) for f in _delta_files(index) for n in re.findall(r"/delta=(\d+)", f)), default=0)
        _write(with_shard(batch, shards).withColumn("delta", F.lit(last + 1)), path, "append")
        return fresh.count()


def compact_index(spark: SparkSession, path: str) -> int:
    """Fold the deltas of an index into its base and return how many files of deltas went.

    Only partitions with deltas are read and rewritten. If the job is lost between its
    steps, the deltas are still there and say the same as the new base.
    """
    with scratch(spark):
        index = spark.read.parquet(path)
        files = _delta_files(index)
        if not files:
            return 0
        touched = durable(index.filter("delta > 0").select(*PLACE).distinct())
        current = index.join(broadcast_if_small(touched, SMALL_KEYS), PLACE, "left_semi")
        # Stored before it overwrites the files it was read from.
        merged = durable(_merged(current))
        kept = {r["name"] for r in merged.select(_place_name().alias("name")).distinct().collect()}
        names = {r["name"] for r in touched.select(_place_name().alias("name")).collect()}
        emptied = [f for f in index.inputFiles() if "/delta=0/" in f and _place_of(f) in names - kept]
        _write(merged.withColumn("delta", F.lit(0)), path)
        _delete_files(spark, [*emptied, *files])
        return len(files)


STAGED = "rep_name string, chunk_index long, text string, embedding array<float>, metadata string, embedding_text string"
_STAGED_PATH = "/([^/]+)/([^/]+)/([^/]+)/staging/([^/]+)\\.parquet(?:/[^/]*)?$"


def rebuild_index(spark: SparkSession, staging: str, schema: str = STAGED) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): every staged chunk file below ``staging``, and the files that could
    not be read, with the reason.

    Staging keeps ``{workspace}/{collection}/{entity}/staging/{rep}.parquet``; names that
    start with an underscore are left out. Each file is opened by itself in a task: one that
    is damaged, or whose columns do not fit ``schema``, costs no other file and is reported.
    Columns a file lacks are null; without a ``rep_name`` its file name is taken. Staged
    files hold one entity, so a file is read whole.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    out = T.StructType([T.StructField("file", T.StringType()), T.StructField("error", T.StringType()), *fields.fields])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = to_arrow_schema(out)
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    table = pq.read_table(pa.BufferReader(content.as_buffer()))
                    n = table.num_rows
                    columns = [
                        table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(n, f.type) for f in arrow
                    ]
                    error = None
                except (pa.ArrowException, OSError, ValueError) as fault:
                    n, error = 1, f"{type(fault).__name__}: {str(fault).splitlines()[0][:200]}"
                    columns = [pa.nulls(1, f.type) for f in arrow]
                head = [pa.array([file] * n, pa.string()), pa.array([error] * n, pa.string())]
                yield from pa.Table.from_arrays([*head, *columns], schema=named).to_batches(max_chunksize=4096)

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        .load(staging).select("path", "content")
    )
    read = durable(files.mapInArrow(opened, out))
    part = lambda i: F.regexp_extract("file", _STAGED_PATH, i)
    placed = read.withColumns({"workspace_id": part(1), "collection_id": part(2), "entity_id": part(3), "_rep": part(4)})
    strange = F.when(F.col("workspace_id") == "", F.lit("not below {workspace}/{collection}/{entity}/staging"))
    placed = placed.withColumn("error", F.coalesce("error", strange)).filter(~F.startswith("entity_id", F.lit("_")))
    rows = placed.filter("error is null")
    if "rep_name" in fields.names:
        rows = rows.withColumn("rep_name", F.coalesce("rep_name", "_rep"))
    rows = rows.select("workspace_id", "collection_id", "entity_id", *fields.names)
    rejected = placed.filter("error is not null").groupBy("workspace_id", "collection_id", "entity_id", "file")
    return rows, rejected.agg(F.min("error").alias("error"))


def indexed_entities(index: DataFrame) -> DataFrame:
    return index.select("workspace_id", "collection_id", "entity_id").distinct()


def indexed_reps(index: DataFrame) -> DataFrame:
    return index.select(*REP_KEY).distinct()


def delete_chunks(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Index without the given entities, or (entity, rep) pairs, or collections,
    whichever columns ``keys`` has."""
    on = [c for c in REP_KEY if c in keys.columns]
    return index.join(keys.select(*on).distinct(), on, "left_anti")


# --- schema ------------------------------------------------------------------------


def align_schema(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Cast to a target schema by name; missing columns become null."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.fields
        ]
    )


def fixed_dimension(df: DataFrame, dim: int, column: str = "embedding") -> bool:
    """Whether every vector has ``dim`` values, so that a fixed size may be declared."""
    return df.filter(F.size(column) != dim).limit(1).count() == 0


def _add_rep_name(df: DataFrame) -> DataFrame:
    if "rep_name" in df.columns:
        return df.withColumn("rep_name", F.coalesce("rep_name", F.lit("canonical_md")))
    return df.withColumn("rep_name", F.lit("canonical_md"))


MIGRATIONS: dict[int, Callable[[DataFrame], DataFrame]] = {2: _add_rep_name}


def migrate(df: DataFrame, from_version: int,
            steps: dict[int, Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, int, int]:
    """Apply the steps above ``from_version`` in order, stopping at the first that
    fails. Returns the table, its version and the number of steps applied."""
    version, applied = from_version, 0
    for number in sorted(steps or MIGRATIONS):
        if number <= from_version:
            continue
        df = (steps or MIGRATIONS)[number](df)
        version, applied = number, applied + 1
    return df, version, applied


def read_merged(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Index files of different schema versions as one table."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)

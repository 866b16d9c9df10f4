"""Ranking many queries at once over the chunk index.

Index rows are ``entity_id, rep_name, chunk_index, text, embedding, ...``;
queries are ``query_id, text`` and/or ``query_id, embedding``. Rankings have a
total order (score, entity, chunk), so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.functions.arrays import let
from tarn.functions.sizes import broadcast_if_small, is_small
from tarn.operators.entities import entity_key
from tarn.session import durable, scratch_path

KEY = ["entity_id", "rep_name", "chunk_index"]
SCOPE = ["workspace_id", "collection_id"]

# Largest query batch sent to every task as one matrix (rows of the matrix).
BROADCAST_QUERIES = 2048
# Mean size of the query batches of an approximate search.
ANN_BATCH = 1536
# Rows of a result or term list that may be broadcast.
SMALL_ROWS = 500_000
# Chunks whose terms are scored at once.
SCANNED = 1024
# Cells of a distance matrix held at once.
_MATRIX_CELLS = 2_000_000


def ensure_rep(index: DataFrame) -> DataFrame:
    """Chunk tables without ``rep_name`` belong to the canonical text."""
    if "rep_name" in index.columns:
        return index
    return index.withColumn("rep_name", F.lit("canonical_md"))


def chunk_key(index: DataFrame) -> list[str]:
    """What names a chunk in ``index``: with workspace and collection where it has them,
    because equal contents have equal ids in every collection. Ties break in this order."""
    return [*KEY, *[c for c in SCOPE if c in index.columns]]


def best_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """Top ``k`` per query with a 1-based ``rank``; cut in each map task first."""
    ranked = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


# --- semantic -------------------------------------------------------------------


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every query (rows) to every vector (columns), in double.

    Rounded to nine digits: the last bits of a matrix product depend on its
    blocking, and equal vectors have to tie.
    """
    if metric == "cosine":
        qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        vn = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return np.round(1.0 - qn @ vn.T, 9)
    norms = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :]
    squares = norms - 2.0 * (q @ v.T)
    # Close pairs lose their digits in this difference and are computed directly.
    rows, cols = np.nonzero(squares < 1e-6 * norms)
    step = max(1, _MATRIX_CELLS // max(1, q.shape[1]))
    for at in range(0, len(rows), step):
        r, c = rows[at:at + step], cols[at:at + step]
        squares[r, c] = np.square(q[r] - v[c]).sum(1)
    return np.round(np.sqrt(np.maximum(squares, 0.0)), 9)


class _TopK:
    """The best ``k`` keys per query seen so far, as flat arrays."""

    def __init__(self, n_queries: int, k: int, key: Sequence[str]):
        self.k = k
        self.key = list(key)
        self.limit = np.full(n_queries, np.inf)
        self.pool: list[pd.DataFrame] = []
        self.pooled = 0

    def add(self, keys: pd.DataFrame, dist: np.ndarray) -> None:
        """``keys`` must be sorted, so that column order breaks ties."""
        cut = self.limit
        if dist.shape[1] > self.k:
            cut = np.minimum(cut, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
        rows, cols = np.nonzero((dist <= cut[:, None]) & np.isfinite(dist))
        near = dist[rows, cols]
        order = np.lexsort((cols, near, rows))
        rows, cols, near = rows[order], cols[order], near[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        if not kept.any():
            return
        found = keys.iloc[cols[kept]].reset_index(drop=True)
        found["_q"], found["distance"] = rows[kept], near[kept]
        self.pool.append(found)
        self.pooled += len(found)
        if self.pooled > 4 * self.k * len(self.limit):
            self.shrink()

    def shrink(self) -> pd.DataFrame:
        merged = pd.concat(self.pool, ignore_index=True).sort_values(["_q", "distance", *self.key])
        merged = merged[merged.groupby("_q").cumcount() < self.k]
        sizes = merged.groupby("_q")["distance"].agg(["size", "max"])
        full = sizes[sizes["size"] == self.k]
        self.limit[full.index.to_numpy()] = full["max"].to_numpy()
        self.pool, self.pooled = [merged], len(merged)
        return merged

    def result(self, query_ids: Sequence) -> pd.DataFrame:
        columns = ["query_id", *self.key, "distance"]
        if not self.pool:
            return pd.DataFrame(columns=columns)
        merged = self.shrink()
        ids = pd.Series(list(query_ids), dtype=object).take(merged["_q"].to_numpy())
        return merged.assign(query_id=ids.to_numpy())[columns].infer_objects()


def _scan_block(top: _TopK, q: np.ndarray, keys: pd.DataFrame, v: np.ndarray, metric: str,
                probed: np.ndarray | None = None, cell: np.ndarray | None = None) -> None:
    """Feed vectors to ``top`` in slices that bound the distance matrix."""
    order = keys.reset_index(drop=True).sort_values(top.key).index.to_numpy()
    width = max(256, _MATRIX_CELLS // max(1, len(q)))
    for at in range(0, len(order), width):
        part = order[at:at + width]
        dist = _distances(q, v[part], metric)
        if probed is not None and cell is not None:
            dist[~probed[:, cell[part]]] = np.inf
        top.add(keys.iloc[part], dist)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _result_schema(index: DataFrame, queries: DataFrame) -> T.StructType:
    """``query_id``, chunk key and distance with the types of the inputs."""
    fields = [queries.schema["query_id"], *[index.schema[c] for c in chunk_key(index)]]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields]).add("distance", "double")


def _result_batch(found: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(found, schema=schema, preserve_index=False)


def conforming_vectors(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector has the expected size (lexical rows carry none)."""
    return df.filter(F.size(column) == dim)


def nearest(index: DataFrame, queries: DataFrame, k: int, dim: int, metric: str = "l2") -> DataFrame:
    """``query_id``, chunk key and distance of the exact ``k`` nearest chunks.

    A query batch up to ``BROADCAST_QUERIES`` goes to every task as a matrix;
    the index is scanned once, each task keeps ``k`` rows per query, and only
    those are shuffled. A larger query table is searched over cells of vectors that are
    written for it, see ``vector_index``, where an index to keep can be written too.
    """
    index = _searchable(index, dim)
    queries = conforming_vectors(queries, dim).select("query_id", "embedding")
    head = queries.orderBy("query_id").limit(BROADCAST_QUERIES + 1).collect()
    if len(head) > BROADCAST_QUERIES:
        from tarn.operators.vector_index import VectorIndex, nearest_written, write_vector_index

        path = scratch_path(index.sparkSession, "vectors")
        write_vector_index(index, path, dim, metric=metric)
        return nearest_written(VectorIndex(index.sparkSession, path), queries, k)
    partial = _scan(index, head, k, dim, metric, _result_schema(index, queries))
    return best_k(partial, k, [F.col("distance"), *map(F.col, chunk_key(index))])


def _searchable(index: DataFrame, dim: int, *more: str) -> DataFrame:
    index = conforming_vectors(ensure_rep(index), dim)
    return index.select(*chunk_key(index), "embedding", *more)


def _scan(index: DataFrame, head: list, k: int, dim: int, metric: str, schema: T.StructType,
          cells: np.ndarray | None = None) -> DataFrame:
    """Each task's best ``k`` chunks for every query row of ``head``; ``cells[query, cell]``
    says which cells a query looks into."""
    ids = [r["query_id"] for r in head]
    matrix = np.array([r["embedding"] for r in head], dtype=np.float64).reshape(-1, dim)
    shared = index.sparkSession.sparkContext.broadcast((ids, matrix, cells))
    arrow = to_arrow_schema(schema)
    key = chunk_key(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, probe = shared.value
        top = _TopK(len(qids), k, key)
        for batch in batches:
            if batch.num_rows == 0 or not qids:
                continue
            keys = pa.Table.from_batches([batch]).select(key).to_pandas()
            cell = batch.column("cell").to_numpy(zero_copy_only=False) if probe is not None else None
            _scan_block(top, q, keys, _matrix(batch.column("embedding"), q.shape[1]), metric, probe, cell)
        found = top.result(qids)
        if len(found):
            yield _result_batch(found, arrow)

    return index.mapInArrow(scan, schema)


def search_semantic(index: DataFrame, queries: DataFrame, k: int = 5, dim: int = 1024,
                    metric: str = "l2") -> DataFrame:
    """Nearest chunks with their payload; ``score`` is the distance, ascending."""
    found = nearest(index, queries, k, dim, metric).withColumnRenamed("distance", "score")
    return with_payload(found, index, queries, k).withColumn("search_type", F.lit("semantic"))


def with_payload(found: DataFrame, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Attach the other index columns to a ranked key list, vectors left out.

    A result has at most ``k`` rows per query. While that product is small the
    result is broadcast to the scan and the index is not shuffled.
    """
    index = ensure_rep(index)
    key = chunk_key(index)
    rest = [c for c in index.columns if c not in (*key, "embedding")]
    if not rest:
        return found
    if is_small(queries, max(1, SMALL_ROWS // k)):
        found = F.broadcast(found)
    return index.select(*key, *rest).join(found, key)


# --- lexical --------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), 0)


def _counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token lists of rows as their number and the distinct terms in order, each with its count."""
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            lists = batch.column("_tokens")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            names = words.dictionary
            order = pc.array_sort_indices(names).to_numpy()
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            width = max(1, len(names))
            code = np.repeat(np.arange(len(size)), size) * width + place[words.indices.to_numpy(zero_copy_only=False)]
            pairs, tf = np.unique(code, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(size) + 1) * width).astype(np.int32)
            term = names.take(pa.array(order[pairs % width], pa.int64()))
            terms = pa.StructArray.from_arrays([term, pa.array(tf, pa.int64())], ["term", "tf"])
            kept = [c for c in batch.schema.names if c != "_tokens"]
            columns = [pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), terms)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "dl", "terms"])


def lexical_terms(index: DataFrame) -> DataFrame:
    """Chunk key, ``dl`` and ``terms``, an array of distinct ``term`` with its ``tf``.

    Counts come from the tokens of the row itself: no shuffle.
    """
    index = ensure_rep(index)
    # A null text is a chunk without terms.
    listed = index.select(*chunk_key(index), tokens(F.coalesce("text", F.lit(""))).alias("_tokens"))
    term = T.StructType().add("term", "string").add("tf", "long")
    schema = T.StructType(listed.drop("_tokens").schema.fields).add("dl", "long").add("terms", T.ArrayType(term))
    return listed.mapInArrow(_counted_terms, schema)


def lexical_postings(index: DataFrame) -> DataFrame:
    """``term, tf, dl`` per chunk and distinct term."""
    return _postings_of(lexical_terms(index))


def _postings_of(chunks: DataFrame) -> DataFrame:
    key = chunk_key(chunks)
    return chunks.select(*key, "dl", F.explode("terms").alias("_p")).select(
        F.col("_p.term").alias("term"), *key, F.col("_p.tf").alias("tf"), "dl"
    )


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in tokens."""
    return index.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.coalesce("text", F.lit(""))))).alias("avgdl")
    )


def write_postings(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Postings on disk, partitioned by a hash of the term and sorted by it, so
    that a search reads the files and row groups of its own terms only. The
    rebalance lets Spark split the bucket of a very common term into several files.
    The number of buckets is stored with the corpus figures."""
    chunks = durable(lexical_terms(index))  # read for the postings and the figures
    postings = _postings_of(chunks).withColumn("bucket", term_bucket(F.col("term"), buckets))
    (
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        .write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy("bucket").parquet(f"{path}/postings")
    )
    stats = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    stats.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/stats")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def rank_postings(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int,
                  k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 top ``k`` per query from a postings table, for query tables of any size.

    Only postings of query terms get past the first join, and they are dealt by chunk: no
    pair of query and chunk is shuffled before a task has cut its own to ``k`` a query."""
    asked = query_terms(queries)
    small = is_small(asked, SMALL_ROWS)
    terms = asked.select("term").distinct()
    matched = postings.join(F.broadcast(terms) if small else terms, "term", "left_semi")
    # Read twice below (document frequencies, scores): the texts are scanned once.
    matched = durable(matched)
    n = stats.select("n").scalar()
    avgdl = stats.select("avgdl").scalar()
    df = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(df, "term").withColumn(
        "idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    )
    part = (
        F.col("idf") * F.col("tf") * (k1 + 1)
        / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    )
    scored = (
        matched.repartition(*chunk_key(postings)).join(F.broadcast(weighted) if small else weighted, "term")
        .groupBy("query_id", *chunk_key(postings))
        .agg(F.round(F.sum(part), 9).alias("score"))
    )
    return best_k(scored, k, [F.desc("score"), *map(F.col, chunk_key(postings))])


def _bm25_state(ids: list, terms: list[list[str]], df: dict[str, int], n: int, total: int,
                k1: float, b: float) -> dict:
    """Query terms with their weights as plain arrays, fit for a broadcast."""
    vocabulary = sorted({t for query in terms for t in query if df.get(t)})
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = sorted((place[t], q) for q, query in enumerate(terms) for t in query if t in place)
    sizes = np.bincount(np.array([t for t, _ in asked], dtype=np.int64), minlength=len(place)).astype(np.int64)
    freq = np.array([df[t] for t in vocabulary], dtype=np.float64)
    return {
        "ids": ids,
        "k1": k1,
        "b": b,
        "avgdl": total / n if n else 1.0,
        "vocabulary": vocabulary,
        "queries": np.array([q for _, q in asked], dtype=np.int64),
        "sizes": sizes,
        "starts": np.cumsum(sizes) - sizes,
        "idf": np.log(1 + (n - freq + 0.5) / (freq + 0.5)),
    }


class _Bm25:
    """Scores batches of chunks for all queries."""

    def __init__(self, state: dict):
        self.__dict__.update(state)

    def scan(self, top: _TopK, batch: pa.RecordBatch) -> None:
        """Score the chunks of a batch for all queries and feed ``top``."""
        keys = pa.Table.from_batches([batch]).select(top.key).to_pandas()
        order = keys.sort_values(top.key).index.to_numpy()
        lists = batch.column("terms")
        flat = lists.flatten()
        found = pc.index_in(flat.field("term"), value_set=pa.array(self.vocabulary, pa.string()))
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = flat.field("tf").to_numpy(zero_copy_only=False)[hit].astype(np.float64)
        rows = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy(zero_copy_only=False))[hit]
        dl = batch.column("dl").to_numpy(zero_copy_only=False)[rows].astype(np.float64)
        weight = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))
        # Rows numbered in key order, so that ties break by key.
        position = np.empty(len(order), dtype=np.int64)
        position[order] = np.arange(len(order))
        rows = position[rows]
        by_row = np.argsort(rows, kind="stable")
        rows, term, weight = rows[by_row], term[by_row], weight[by_row]
        pairs = self.sizes[term].sum() / max(1, len(order))
        width = int(max(32, min(_MATRIX_CELLS // max(1, len(self.ids)), 2 * _MATRIX_CELLS // max(1.0, pairs))))
        for at in range(0, len(order), width):
            part = order[at:at + width]
            lo, hi = np.searchsorted(rows, [at, at + width])
            times = self.sizes[term[lo:hi]]
            total = int(times.sum())
            if total == 0:
                continue
            ahead = np.cumsum(times) - times
            which = np.repeat(self.starts[term[lo:hi]] - ahead, times) + np.arange(total)
            cell = self.queries[which] * len(part) + np.repeat(rows[lo:hi] - at, times)
            score = np.bincount(cell, np.repeat(weight[lo:hi], times), len(self.ids) * len(part))
            score = np.round(score.reshape(len(self.ids), len(part)), 9)
            top.add(keys.iloc[part], np.where(score > 0, -score, np.inf))


def rank_chunks(index: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 top ``k`` per query, scored where the chunks lie.

    All terms of a chunk are in its row, so a task knows the full score of its
    chunks for every query and only ``k`` rows per query leave it. That needs the
    queries in every task: a larger batch is ranked by :func:`rank_postings`.
    """
    # A null query asks for nothing.
    asked = queries.select("query_id", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("terms"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("t")).first()
    if size["n"] > BROADCAST_QUERIES or (size["t"] or 0) > SMALL_ROWS:
        return rank_postings(lexical_postings(index), corpus_stats(index), queries, k, k1, b)
    head = asked.orderBy("query_id").collect()
    spark = index.sparkSession
    chunks = durable(lexical_terms(index))  # counted, then scored
    # One pass counts chunks and tokens (under the empty term) and query terms.
    words = sorted({t for r in head for t in r["terms"]} | {""})
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in words], "term string"))
    whole = F.array(F.struct(F.lit("").alias("term"), F.col("dl").alias("tf")))
    counted = (
        chunks.select(F.explode(F.concat("terms", whole)).alias("_p")).select("_p.*")
        .join(wanted, "term", "left_semi")
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).collect()
    )
    frequency = {r["term"]: r["df"] for r in counted}
    n, total = next(((r["df"], r["total"]) for r in counted if r["term"] == ""), (0, 0))
    state = _bm25_state([r["query_id"] for r in head], [r["terms"] for r in head], frequency, n, total, k1, b)
    shared = spark.sparkContext.broadcast(state)
    schema = _result_schema(chunks, queries)
    arrow = to_arrow_schema(schema)
    key = chunk_key(chunks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _Bm25(shared.value)
        top = _TopK(len(mine.ids), k, key)
        for batch in batches:
            if batch.num_rows and mine.vocabulary:
                for start in range(0, batch.num_rows, SCANNED):
                    mine.scan(top, batch.slice(start, SCANNED))
        found = top.result(mine.ids)
        if len(found):
            yield _result_batch(found, arrow)

    partial = chunks.mapInArrow(scan, schema)
    ranked = best_k(partial, k, [F.col("distance"), *map(F.col, key)])
    return ranked.select("query_id", *key, (-F.col("distance")).alias("score"), "rank")


def search_lexical(index: DataFrame, queries: DataFrame, k: int = 5, payload: bool = True) -> DataFrame:
    """BM25 over ``text``."""
    found = rank_chunks(index, queries, k)
    found = with_payload(found, index, queries, k) if payload else found
    return found.withColumn("search_type", F.lit("lexical"))


def search_lexical_written(spark, path: str, queries: DataFrame, k: int = 5, buckets: int | None = None) -> DataFrame:
    """BM25 over written postings; the buckets of the query terms are read. Their number
    is the stored one; another one is refused."""
    stats = spark.read.parquet(f"{path}/stats")
    stored = stats.select("buckets").head()[0] if "buckets" in stats.columns else buckets
    if not stored:
        raise ValueError(f"{path} does not store its number of buckets")
    if buckets and stored != buckets:
        raise ValueError(f"{path} is written in {stored} buckets, not {buckets}")
    postings = spark.read.parquet(f"{path}/postings")
    wanted = query_terms(queries).select(term_bucket(F.col("term"), stored).alias("bucket")).distinct()
    pruned = postings.filter(F.col("bucket").isin([r["bucket"] for r in wanted.collect()]))
    return rank_postings(pruned.drop("bucket"), stats, queries, k).withColumn("search_type", F.lit("lexical"))


def needles_in(text: Column, asked: Column) -> Column:
    """Those of ``asked`` (``needle``, in lower case) that ``text`` holds; it is lowered once.
    Explode it with ``explode_outer``: for ``explode`` Spark adds a filter that searches again."""
    return let(F.lower(text), lambda hay: F.filter(asked, lambda q: F.contains(hay, q["needle"])))


def substring_hits(index: DataFrame, queries: DataFrame, block: int = 512) -> DataFrame:
    """``query_id`` and chunk key of every case-insensitive substring match.

    Queries travel as one array per block of at most about ``block`` of them and
    are tested inside the scan: no pair of chunk and query exists before it
    matches, and the array has a known bound.
    """
    index = ensure_rep(index)
    key = chunk_key(index)
    n_blocks = max(1, -(-queries.count() // block))
    found = None
    for i in range(n_blocks):
        mine = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i)
        asked = mine.agg(
            F.collect_list(F.struct("query_id", F.lower("text").alias("needle")))
        ).scalar()
        hits = (
            index.withColumn("_asked", asked)
            .select(*key, F.explode_outer(needles_in(F.col("text"), F.col("_asked"))).alias("_q"))
            .where("_q IS NOT NULL")
            .select("_q.query_id", *key)
        )
        found = hits if found is None else found.unionByName(hits)
    return found


def search_substring(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Substring matches, first ``k`` chunks in key order."""
    hits = substring_hits(index, queries)
    ranked = best_k(hits, k, [F.col(c) for c in chunk_key(hits)])
    return ranked.withColumn("score", 1.0 / F.col("rank")).withColumn("search_type", F.lit("substring"))


# --- fusion ---------------------------------------------------------------------


def fuse_rrf(channels: Sequence[tuple[DataFrame, float]], k: int, rrf_k: int = 60,
             key: Sequence[str] = ("entity_id", "chunk_index")) -> DataFrame:
    """Reciprocal rank fusion of ranked channels (``query_id``, key, 1-based ``rank``).
    Workspace and collection belong to the key where the channels have them.

    The row that represents a key is its last one in the first channel that has
    it. Ties keep channel order, then rank.
    """
    key = [*key, *[c for c in SCOPE if c in channels[0][0].columns and c not in key]]
    parts = None
    for order, (df, weight) in enumerate(channels):
        rest = [c for c in df.columns if c not in ("query_id", *key, "rank", "score", "search_type")]
        part = df.select(
            "query_id",
            *key,
            F.lit(order).alias("_channel"),
            F.col("rank").alias("_rank"),
            (F.lit(float(weight)) / (rrf_k + F.col("rank"))).alias("_part"),
            F.struct(*rest).alias("_payload"),
        )
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    fused = parts.groupBy("query_id", *key).agg(
        F.sum("_part").alias("score"),
        F.min(F.struct("_channel", "_rank")).alias("_first"),
        F.min_by("_payload", F.struct(F.col("_channel"), -F.col("_rank"))).alias("_payload"),
    )
    order = [F.desc(F.round("score", 12)), F.col("_first"), *map(F.col, key)]
    ranked = best_k(fused, k, order)
    return ranked.select("query_id", *key, "_payload.*", "score", "rank").withColumn(
        "search_type", F.lit("hybrid")
    )


def search_hybrid(index: DataFrame, queries: DataFrame, k: int = 5, dim: int = 1024, rrf_k: int = 60,
                  semantic_weight: float = 0.7, lexical_weight: float = 0.3, metric: str = "l2",
                  key: Sequence[str] = ("entity_id", "chunk_index"), text_index=None) -> DataFrame:
    """Both channels with ``3k`` rows each, fused; texts join the final rows only.

    With ``text_index``, the written index (``text_index.TextIndex``) of the same chunks, the
    lexical channel reads the postings of its terms instead of all texts."""
    queries = durable(queries)  # read by both channels and counted
    semantic = nearest(index, queries, 3 * k, dim, metric).drop("distance")
    if text_index is None:
        lexical = search_lexical(index, queries, 3 * k, payload=False).drop("score", "search_type")
    else:
        from tarn.operators.text_index import rank_written

        lexical = rank_written(text_index, queries, 3 * k).drop("score")
    fused = fuse_rrf([(semantic, semantic_weight), (lexical, lexical_weight)], k, rrf_k, key)
    return with_payload(fused, index, queries, k)


SEARCHES: dict[str, Callable[..., DataFrame]] = {
    "semantic": search_semantic,
    "lexical": search_lexical,
    "hybrid": search_hybrid,
}


def search(index: DataFrame, queries: DataFrame, search_type: str = "hybrid", k: int = 5,
           entities: DataFrame | None = None, where: Column | None = None, include_hidden: bool = False,
           **options) -> DataFrame:
    """Dispatch by type; queries without a vector are searched lexically.

    With ``entities`` only chunks of enabled ones are searched, unless hidden ones
    are asked for; ``where`` restricts the chunks further.
    """
    if entities is not None:
        index = visible_chunks(index, entities, where, include_hidden)
    elif where is not None:
        index = index.filter(where)
    if search_type not in SEARCHES:
        raise ValueError(f"unknown search type {search_type!r}")
    if search_type == "lexical" or "embedding" not in queries.columns:
        return search_lexical(index, queries, k)
    queries = durable(queries)  # counted, split and ranked below
    has_vector = F.size(F.coalesce("embedding", F.array().cast("array<float>"))) > 0
    found = SEARCHES[search_type](index, queries.filter(has_vector), k, **options)
    bare = queries.filter(~has_vector)
    if "text" not in queries.columns or is_small(bare, 0):
        return found
    return found.unionByName(search_lexical(index, bare, k), allowMissingColumns=True)


# --- restricted search -------------------------------------------------------------


def visible_chunks(index: DataFrame, entities: DataFrame, where: Column | None = None,
                   include_hidden: bool = False) -> DataFrame:
    """Chunks that may be searched: of enabled entities, and matching ``where``."""
    chosen = index if where is None else index.filter(where)
    if include_hidden:
        return chosen
    keys = entity_key(index, entities)
    enabled = entities.filter(F.col("status").isin("enabled", "active")).select(*keys)
    return chosen.join(broadcast_if_small(enabled, SMALL_ROWS), keys, "left_semi")


def search_within(index: DataFrame, queries: DataFrame, entity_ids: DataFrame, k: int = 5,
                  dim: int = 1024, metric: str = "l2") -> DataFrame:
    """Semantic search inside the entities a query over tables selected."""
    keys = entity_key(index, entity_ids)
    wanted = broadcast_if_small(entity_ids.select(*keys).distinct(), SMALL_ROWS)
    inside = index.join(wanted, keys, "left_semi")
    return search_semantic(inside, queries, k, dim, metric)


def search_dual(first: DataFrame, second: DataFrame, queries: DataFrame, k: int, dim: int,
                metric: str = "l2") -> DataFrame:
    """Two vector columns searched apart (say audio and transcript) and merged by
    the smaller distance per chunk."""
    both = nearest(first, queries, k, dim, metric).withColumn("channel", F.lit("first")).unionByName(
        nearest(second, queries, k, dim, metric).withColumn("channel", F.lit("second"))
    )
    key = chunk_key(both)
    merged = both.groupBy("query_id", *key).agg(
        F.min("distance").alias("distance"),
        F.min_by("channel", F.struct("distance", "channel")).alias("channel"),
    )
    return best_k(merged, k, [F.col("distance"), *map(F.col, key)])


def evidence_pack(chunks: DataFrame, table_rows: DataFrame, grep_hits: DataFrame, k: int,
                  rrf_k: int = 60) -> DataFrame:
    """Evidence of three kinds in one schema, without repeats, fused by rank.

    Inputs carry ``query_id, entity_id, evidence_id, score``, and workspace and collection
    if they reach over several: equal ids of two collections are two pieces of evidence. A
    table row without a score counts 1.0.
    """
    parts = None
    for order, (kind, df) in enumerate(
        [("chunk", chunks), ("table_row", table_rows), ("grep_hit", grep_hits)]
    ):
        part = df.withColumn("type", F.lit(kind)).withColumn("_order", F.lit(order))
        if "score" not in part.columns:
            part = part.withColumn("score", F.lit(1.0))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    parts = parts.withColumn("score", F.coalesce("score", F.lit(1.0)))
    scope = [c for c in SCOPE if c in parts.columns]
    key = ["query_id", "type", *scope, "entity_id", "evidence_id"]
    rest = [c for c in parts.columns if c not in key]
    unique = parts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("score")).alias("_r")).select(*key, "_r.*")
    # A list longer than k cannot reach the first k places beyond its own k-th row.
    by_type = Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "entity_id", "evidence_id", *scope)
    listed = unique.withColumn("type_rank", F.row_number().over(by_type)).filter(F.col("type_rank") <= k)
    fused = listed.withColumn("fused", 1.0 / (rrf_k + F.col("type_rank")))
    order = [F.desc("fused"), F.col("_order"), F.col("entity_id"), F.col("evidence_id"), *map(F.col, scope)]
    return best_k(fused, k, order).drop("_order")


def locate_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each hit (``entity_id, hit_id, position``) with the nearest chunk that starts
    at or before it, in the same workspace and collection where the tables have them."""
    from tarn.functions.ordered import carry_last, ordered_blocks

    key = entity_key(hits, chunks)
    both = chunks.select(
        *key, F.col("start_pos").alias("position"), F.lit(0).alias("_kind"),
        F.col("chunk_index"), F.lit(None).cast("long").alias("hit_id"),
    ).unionByName(
        hits.select(
            *key, "position", F.lit(1).alias("_kind"),
            F.lit(None).cast("long").alias("chunk_index"), "hit_id",
        )
    )
    blocks = ordered_blocks(both, key, ["position", "_kind", "chunk_index", "hit_id"])
    carried = carry_last(blocks, key, F.col("chunk_index"), "_nearest")
    return carried.filter("_kind = 1").select(
        *key, "hit_id", "position", F.col("_nearest").alias("chunk_index")
    )


# --- approximate --------------------------------------------------------------------


def fit_cells(index: DataFrame, cells: int, dim: int, seed: int = 7, max_iter: int = 8) -> np.ndarray:
    """Cell centres by distributed k-means over the whole index."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = conforming_vectors(index, dim).select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, initSteps=2).fit(vectors)
    return np.array(model.clusterCenters())


def assign_cells(index: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """Add ``cell``, the nearest centre. Write the result with
    ``partitionBy('cell')`` and a search opens only the cells it probes."""
    shared = index.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        v = np.stack(vectors.to_list()).astype(np.float64)
        return pd.Series(_distances(v, shared.value, "l2").argmin(1).astype(np.int32))

    return conforming_vectors(index, dim).withColumn("cell", cell("embedding"))


def search_ann(celled: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, dim: int,
               probe: int = 4, metric: str = "l2") -> DataFrame:
    """Approximate nearest chunks: each query looks into its ``probe`` nearest cells.

    Vectors of one cell stay in as many partitions as the scan gives them, so a
    large cell is not a large task. Queries are searched in batches of one broadcast;
    where there are several, the results of each are stored before the next begins.
    """
    index = _searchable(celled, dim, "cell")
    queries = conforming_vectors(queries, dim).select("query_id", "embedding")
    n_batches = max(1, -(-queries.count() // ANN_BATCH))
    placed = queries if n_batches == 1 else durable(
        queries.withColumn("_batch", F.pmod(F.xxhash64("query_id"), F.lit(n_batches)))
    )
    schema = _result_schema(index, queries)
    partial = None
    for i in range(n_batches):
        head = (placed if n_batches == 1 else placed.filter(F.col("_batch") == i)).collect()
        q = np.array([r["embedding"] for r in head], dtype=np.float64).reshape(-1, dim)
        near = np.argsort(_distances(q, centres, "l2"), axis=1)[:, :probe]
        mask = np.zeros((len(head), len(centres)), dtype=bool)
        np.put_along_axis(mask, near, True, axis=1)
        opened = index.filter(F.col("cell").isin(sorted({int(c) for c in near.ravel()})))
        found = _scan(opened, head, k, dim, metric, schema, mask)
        found = found if n_batches == 1 else durable(found)
        partial = found if partial is None else partial.unionByName(found)
    return best_k(partial, k, [F.col("distance"), *map(F.col, chunk_key(index))])

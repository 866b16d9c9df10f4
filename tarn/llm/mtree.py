"""Exact top-k by inner product, over M-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import durable, scratch_path

SCALE = 64
K = 20
EVERY = 20
#: Rows of a leaf page, children of a node, rows of a tree.
PAGE = 128
FAN_OUT = 8
TREE_ROWS = 4096
#: Queries that a task holds at once.
QUERY_BLOCK = 4096
#: Share of the pairs of a page below which scores are computed pair by pair.
SPARSE = 0.05

TREES = (
    "dim int, ids array<long>, vectors binary, top double, parent array<int>, pivot binary, "
    "radius array<double>, pivot_distance array<double>, first array<int>, last array<int>, row_distance array<double>"
)
HITS = "query_id long, vec_id long, score long, scored long"


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) with every component x as floor(64 * x), of the rows whose vectors are
    whole: not null, not empty, without null or non-finite components."""
    v = F.transform(vector_column, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("x"), bad.alias("bad"))
    rows = rows.where("vec_id is not null and x is not null and size(x) > 0 and not coalesce(bad, true)")
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Builder:
    """Bulk load of one tree: rows are dealt to the nearest of a few pivots, level by level."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.parent: list[int] = []
        self.pivot: list[np.ndarray] = []
        self.radius: list[float] = []
        self.distance: list[float] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.order: list[np.ndarray] = []
        self.row_distance: list[np.ndarray] = []
        self.placed = 0
        self._add(np.arange(len(points)), -1)

    def _add(self, rows: np.ndarray, parent: int) -> None:
        points = self.points[rows]
        middle = points.mean(axis=0)
        pivot = points[np.argmin(((points - middle) ** 2).sum(axis=1))]
        away = _distances(points, pivot[None])[:, 0]
        node = len(self.parent)
        self.parent.append(parent)
        self.pivot.append(pivot)
        self.radius.append(float(away.max()))
        self.distance.append(0.0 if parent < 0 else float(_distances(pivot[None], self.pivot[parent][None])[0, 0]))
        self.first.append(-1)
        self.last.append(-1)
        if len(rows) <= PAGE:
            self.first[node] = self.placed
            self.placed += len(rows)
            self.last[node] = self.placed
            self.order.append(rows)
            self.row_distance.append(away)
            return
        n = min(FAN_OUT, -(-len(rows) // PAGE))
        chosen = [int(np.argmax(away))]
        gap = _distances(points, points[chosen])[:, 0]
        while len(chosen) < n:  # each next pivot is the farthest from those before
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, _distances(points, points[chosen[-1:]])[:, 0])
        near = _distances(points, points[chosen]).argmin(axis=1)
        groups = [rows[near == k] for k in range(n)]
        if max(map(len, groups)) > 0.9 * len(rows):  # copies of one vector: any division will do
            groups = np.array_split(rows[np.argsort(near, kind="stable")], n)
        for group in groups:
            if len(group):
                self._add(group, node)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of ``TREES`` for each TREE_ROWS vectors of a dimension."""
    held: dict[int, list[tuple[int, list[int]]]] = {}

    def tree(dim: int, rows: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], np.int64)
        v = np.array([r[1] for r in rows], np.int64).reshape(-1, dim)
        # With one more coordinate every vector has the same norm, and the nearest one is
        # the one with the largest inner product; a query has 0 there.
        f = v.astype(float)
        square = (f * f).sum(axis=1)
        top = float(square.max())
        b = Builder(np.column_stack([f, np.sqrt(top - square)]))
        order = np.concatenate(b.order)
        columns = {
            "dim": [dim],
            "ids": [ids[order].tolist()],
            "vectors": [v[order].tobytes()],
            "top": [top],
            "parent": [b.parent],
            "pivot": [np.array(b.pivot).tobytes()],
            "radius": [b.radius],
            "pivot_distance": [b.distance],
            "first": [b.first],
            "last": [b.last],
            "row_distance": [np.concatenate(b.row_distance).tolist()],
        }
        small = pa.list_(pa.int32())
        kinds = {"dim": pa.int32(), "parent": small, "first": small, "last": small, "vectors": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kinds.get(c)) for c, x in columns.items()], names=list(columns)
        )

    for batch in batches:
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            rows = held.setdefault(len(v), [])
            rows.append((i, v))
            if len(rows) == TREE_ROWS:
                yield tree(len(v), held.pop(len(v)))
    for dim, rows in held.items():
        yield tree(dim, rows)


class Search:
    """The best k of each query so far, over the trees seen by a task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.f = vectors.astype(float)
        self.square = (self.f * self.f).sum(axis=1)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scored = np.zeros(len(ids), np.int64)

    def reach(self, q: np.ndarray, top: float) -> np.ndarray:
        """Distance beyond which nothing can enter a query's list, with room for rounding."""
        kth = np.where(self.best[q, -1] == np.iinfo(np.int64).min, -np.inf, self.best[q, -1].astype(float))
        square = self.square[q] + top - 2 * kth
        return np.sqrt(np.maximum(square, 0)) + 1e-6 * (1 + np.sqrt(self.square[q] + top))

    def add(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray) -> None:
        """Merge the rows of a page; ``near`` tells which rows each query must look at. Scores
        of others are not computed: pair by pair where few are left, else as a product of the
        queries and rows that have any."""
        self.scored[q] += near.sum(axis=1)
        rows = np.flatnonzero(near.any(axis=0))
        some = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            return
        q, ids, vectors, near = q[some], ids[rows], vectors[rows], near[np.ix_(some, rows)]
        if near.mean() < SPARSE:
            a, b = np.nonzero(near)
            score = np.zeros(near.shape, np.int64)
            score[a, b] = np.einsum("ij,ij->i", self.v[q[a]], vectors[b])
        elif float(np.abs(self.f[q]).max()) * float(np.abs(vectors).max()) * vectors.shape[1] < 2**52:
            score = (self.f[q] @ vectors.T.astype(float)).astype(np.int64)
        else:
            score = self.v[q] @ vectors.T
        kth, kth_id = self.best[q, -1][:, None], self.best_id[q, -1][:, None]
        near = near & ((score > kth) | ((score == kth) & (ids < kth_id))) & (self.ids[q][:, None] != ids)
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return
        q, near = q[some], near[some]
        none = np.iinfo(np.int64)
        scores = np.concatenate([self.best[q], np.where(near, score[some], none.min)], axis=1)
        names = np.concatenate([self.best_id[q], np.where(near, ids, none.max)], axis=1)
        order = np.lexsort((names, ~scores), axis=1)[:, : self.k]
        self.best[q] = np.take_along_axis(scores, order, axis=1)
        self.best_id[q] = np.take_along_axis(names, order, axis=1)

    def tree(self, t: dict) -> None:
        """Search one tree for all queries, each visiting its own pages best first."""
        dim = t["dim"]
        ids = np.array(t["ids"], np.int64)
        rows = np.frombuffer(t["vectors"], np.int64).reshape(-1, dim)
        parent, first, last = (np.array(t[c]) for c in ("parent", "first", "last"))
        pivot = np.frombuffer(t["pivot"]).reshape(-1, dim + 1)
        radius, apart = np.array(t["radius"]), np.array(t["pivot_distance"])
        row_distance = np.array(t["row_distance"])
        n = len(parent)
        everyone = np.arange(len(self.ids))
        points = np.column_stack([self.f, np.zeros(len(self.f))])
        # Distances to pivots, computed only where the distance to the parent's pivot does
        # not rule the node out already; the least distance to anything in the node.
        distance = np.full((n, len(everyone)), np.inf)
        least = np.full((n, len(everyone)), np.inf)
        limit = self.reach(everyone, t["top"])
        for node in range(n):
            if parent[node] < 0:
                q = everyone
                sure = np.zeros(len(q))
            else:
                up = parent[node]
                sure = np.maximum(least[up], np.abs(distance[up] - apart[node]) - radius[node])
                q = np.flatnonzero(np.isfinite(distance[up]) & (sure <= limit))
                sure = sure[q]
            if len(q):
                distance[node, q] = _distances(points[q], pivot[node][None])[:, 0]
                least[node, q] = np.maximum(sure, distance[node, q] - radius[node])
                distance[node, q[least[node, q] > limit[q]]] = np.inf
        leaves = np.flatnonzero(first >= 0)
        order = np.argsort(least[leaves], axis=0, kind="stable")
        for turn in range(len(leaves)):
            leaf = leaves[order[turn]]
            limit = self.reach(everyone, t["top"])
            go = np.isfinite(distance[leaf, everyone]) & (least[leaf, everyone] <= limit)
            if not go.any():
                # Later pages of a query are no nearer than this one.
                break
            active = np.flatnonzero(go)
            by_leaf = active[np.argsort(leaf[active], kind="stable")]
            cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
            for q in np.split(by_leaf, cuts):
                page = leaf[q[0]]
                span = slice(first[page], last[page])
                near = np.abs(distance[page, q][:, None] - row_distance[span]) <= limit[q][:, None]
                self.add(q, ids[span], rows[span], near)


def _block_of(path: str, block: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a block of queries by dimension, read in the task that needs them."""
    fs, root = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(f"{root}/block={block}")) if f.path.endswith(".parquet")]
    tables = [pq.ParquetFile(fs.open_input_file(f)).read(["vec_id", "v"]) for f in sorted(files)]
    rows = pa.concat_tables(tables).combine_chunks()
    ids, v = rows.column("vec_id").to_numpy(), rows.column("v").chunk(0)
    sizes, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    by_dim = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        by_dim[d] = ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)]
    return by_dim


def _refuse_overflow(vectors: DataFrame, column: str) -> None:
    """Scores are 64-bit integers: components for which one could overflow are refused."""
    size = F.abs(F.col("x").cast("double"))
    rows = vectors.select(F.size(column).alias("n"), F.explode(column).alias("x")).where(size < float("inf"))
    seen = rows.agg(F.max("n").alias("n"), F.max(size).alias("x")).first()
    if seen["n"] and (SCALE * seen["x"] + 1) ** 2 * seen["n"] >= 2.0**63:
        raise ValueError(f"components as large as {seen['x']:g} in {seen['n']} dimensions: scores do not fit 64 bits")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_scored): for each vector whose vec_id is divisible by
    ``every`` the ``k`` others with the largest inner product, ties to the smaller vec_id.
    ``n_scored`` says for how many rows the score of the query was computed; all others were
    ruled out by the bounds of the trees.

    All vectors are loaded into trees, a few thousand in each, in the tasks that hold them.
    Queries are written in blocks to the shared folder and read there by the tasks, one block
    at a time; the index is read where it lies, once for each block, and a task returns k rows
    for each query. The driver sees block numbers only. Scores are exact integers; distances
    only decide which pages and rows need not be looked at.

    Vectors that are null, empty or hold null or non-finite components take no part; finite
    components so large that a score could leave 64 bits are refused. Vectors are compared
    with those of the same dimension. Rows with the query's own id are left out; other
    repeated rows are each ranked. Of several query rows with one id the least vector is asked
    for. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    _refuse_overflow(vectors, vector_column)
    rows = durable(quantised(vectors, "vec_id", vector_column))
    trees = durable(rows.mapInArrow(build, TREES))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = durable(asked)
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")
    questions, path = scratch_path(spark, "queries"), scratch_path(spark, "top")
    asked.select("*", block).repartition("block").write.partitionBy("block").parquet(questions)
    numbers = [r["block"] for r in asked.select(block).distinct().orderBy("block").collect()]
    parts = []
    for b in numbers:

        def search(batches: Iterator[pa.RecordBatch], b: int = b) -> Iterator[pa.RecordBatch]:
            queries, found = None, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    queries = _block_of(questions, b) if queries is None else queries
                    tree = batch.slice(i, 1).to_pylist()[0]
                    if tree["dim"] in queries:
                        if tree["dim"] not in found:
                            found[tree["dim"]] = Search(*queries[tree["dim"]], k)
                        found[tree["dim"]].tree(tree)
            for s in found.values():
                real = s.best_id != np.iinfo(np.int64).max
                n = int(real.sum())
                # A row without an id tells how many scores were computed here.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.repeat(s.ids, k)[real.ravel()], s.ids])),
                        pa.array(np.concatenate([s.best_id[real], s.ids]), mask=np.arange(n + len(s.ids)) >= n),
                        pa.array(np.concatenate([s.best[real], s.scored])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), s.scored])),
                    ],
                    names=["query_id", "vec_id", "score", "scored"],
                )

        hits = trees.mapInArrow(search, HITS)
        place = Window.partitionBy("query_id").orderBy(F.col("vec_id").isNull(), F.desc("score"), "vec_id")
        # Each task sends at most k rows and one more for a query.
        total = F.sum("scored").over(Window.partitionBy("query_id")).alias("n_scored")
        ranked = hits.select("*", F.row_number().over(place).cast("int").alias("rank"), total)
        ranked = ranked.where((F.col("rank") <= k) & F.col("vec_id").isNotNull())
        ranked = ranked.select("query_id", "rank", "vec_id", "score", "n_scored")
        if len(numbers) == 1:
            return ranked
        ranked.write.parquet(f"{path}/block={b}")
        parts.append(f"{path}/block={b}")
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, n_scored long")
    return spark.read.parquet(*parts)


SQL = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""

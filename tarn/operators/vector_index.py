"""Vectors on disk by cells, searched exactly for query tables of any size, or approximately.

``write_vector_index`` deals the vectors to the nearest of some centres and writes each cell as
a folder, beside a small table of centres, radii and sizes. A search deals the queries by
their nearest cell into blocks; a task holds a block and reads the cells that can matter to
it from the index, so no pair of query and cell or vector is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.rowid import with_row_id
from tarn.functions.sizes import broadcast_if_small
from tarn.operators import search as S
from tarn.operators.search import _distances, _matrix

#: Vectors of a cell that the number of cells aims at, and cells at most.
CELL_ROWS, MOST_CELLS = 512, 1024
#: Numbers in the sample that centres are fitted on, and rounds of fitting.
SAMPLE_NUMBERS, ROUNDS = 4_000_000, 6
#: Queries of a block, and vectors of a cell compared at once; queries of a task.
PART, TASK = 4096, 16384
#: Pairs whose scores are held at once, and numbers of vectors that a task keeps.
TILE, KEPT = 1 << 20, 8_000_000


def _geometry(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose Euclidean distance orders like the metric and obeys the triangle
    inequality: unit vectors for cosine, where the distance is half the square of theirs."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if metric == "cosine" else v


def _centres(rows: DataFrame, cells: int, dim: int, metric: str) -> np.ndarray:
    """k-means on a sample of bounded size, chosen by a hash of the key."""
    sample = rows.orderBy(F.xxhash64(*S.chunk_key(rows))).limit(max(cells, SAMPLE_NUMBERS // dim)).select("embedding").toArrow()
    v = _geometry(_matrix(sample.column("embedding"), dim), metric)
    centres = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)] if len(v) else np.zeros((1, dim))
    for _ in range(ROUNDS if len(v) else 0):
        near = np.concatenate([_distances(v[a : a + 4096], centres, "l2").argmin(1) for a in range(0, len(v), 4096)])
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        # A centre that lost all its vectors stays where it is.
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def write_vector_index(index: DataFrame, path: str, dim: int, cells: int | None = None, metric: str = "l2") -> None:
    """Write the vectors of ``index`` that have ``dim`` components, with their keys, by cells.

    The number of cells follows from the number of rows unless it is given. Centres are fitted
    on a sample of ``SAMPLE_NUMBERS`` numbers; every vector is indexed.
    """
    rows = S._searchable(index, dim)
    spark = rows.sparkSession
    # Places in key order: ties of distances break by them.
    rows = with_row_id(rows, S.chunk_key(rows), "place")
    cells = cells or min(MOST_CELLS, max(1, rows.count() // CELL_ROWS))
    sent = spark.sparkContext.broadcast(_centres(rows, cells, dim, metric))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            v = _geometry(_matrix(batch.column("embedding"), dim), metric)
            away = _distances(v, centres, "l2")
            cell = away.argmin(1)
            columns = [*batch.columns, pa.array(away[np.arange(len(v)), cell]), pa.array(cell, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "away", "cell"])

    placed = rows.mapInArrow(place, T.StructType(list(rows.schema.fields)).add("away", "double").add("cell", "integer"))
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", *S.chunk_key(rows)).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("cell").parquet(f"{path}/vectors")
    schema = T.StructType(list(rows.schema.fields)).add("away", "double").add("cell", "integer")
    sizes = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell")
    sizes = {r["cell"]: r for r in sizes.agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    table = [(i, c.tolist(), sizes[i]["radius"], sizes[i]["n"]) for i, c in enumerate(sent.value) if i in sizes]
    spark.createDataFrame(table, "cell int, centre array<double>, radius double, n long").withColumns(
        {"dim": F.lit(dim), "metric": F.lit(metric), "schema": F.lit(schema.json())}
    ).write.mode("overwrite").parquet(f"{path}/cells")


class VectorIndex:
    """A written index; its centres, at most ``MOST_CELLS`` unless more were asked for, are read once."""

    def __init__(self, spark: SparkSession, path: str):
        import json

        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.empty = not rows
        if rows:
            self.dim, self.metric = rows[0]["dim"], rows[0]["metric"]
            self.cell = np.array([r["cell"] for r in rows])
            self.centre = np.array([r["centre"] for r in rows])
            self.radius = np.array([r["radius"] for r in rows])
            self.n = np.array([r["n"] for r in rows])
            schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
            self.vectors = spark.read.schema(schema).parquet(f"{path}/vectors").drop("away")
            if "place" not in self.vectors.columns:
                raise ValueError(f"{path} holds no places, it has to be written again")
            self.key = S.chunk_key(self.vectors)


def _first_cells(size: np.ndarray, away: np.ndarray, k: int, probe: int | None) -> np.ndarray:
    """Per query the nearest cells, until they hold ``k`` vectors, or the ``probe`` nearest."""
    order = np.argsort(away, axis=1, kind="stable")
    held = np.cumsum(size[order], axis=1)
    lead = np.arange(len(size))[None, :] < probe if probe else (held - size[order]) < k
    first = np.zeros(away.shape, bool)
    np.put_along_axis(first, order, np.broadcast_to(lead, away.shape), axis=1)
    return first


def _reached(least: np.ndarray, kth: np.ndarray, metric: str) -> np.ndarray:
    """Whether a cell whose nearest point is at least ``least`` away can hold a vector as near as ``kth``."""
    reach = np.sqrt(2 * np.maximum(kth, 0)) if metric == "cosine" else kth
    slack = 1e-6 * (1 + np.where(np.isfinite(reach), reach, 0)) + 1e-4 * (metric == "cosine")
    return ~(least > reach + slack)


def _pairs(index: VectorIndex, queries: DataFrame, k: int, probe: int | None, second: bool) -> DataFrame:
    """(query_id, cell) of the cells that queries look into, to see what an index rules out: the
    nearest ones, or all others that can hold a vector as near as ``kth``."""
    dim, metric, cell, centre, radius, size = index.dim, index.metric, index.cell, index.centre, index.radius, index.n

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, PART):
                batch = whole.slice(a, PART)
                away = _distances(_geometry(_matrix(batch.column("embedding"), dim), metric), centre, "l2")
                chosen = _first_cells(size, away, k, probe)
                if second:
                    kth = batch.column("kth").to_numpy(zero_copy_only=False)[:, None]
                    chosen = ~chosen & _reached(away - radius, kth, metric)
                row, at = np.nonzero(chosen)
                columns = [batch.column("query_id").take(pa.array(row)), pa.array(cell[at], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "cell"])

    return queries.mapInArrow(pair, T.StructType([queries.schema["query_id"]]).add("cell", "integer"))


class _Cells:
    """The vectors of cells as a task reads them; the last ones stay, up to ``KEPT`` numbers."""

    def __init__(self, uri: str, dim: int, metric: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(uri)
        self.dim, self.metric = dim, metric
        self.kept: dict[int, list] = {}
        self.numbers = 0

    def read(self, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, vectors), a bounded part at a time; vectors that are not finite are near to nothing."""
        if cell in self.kept:
            yield from self.kept[cell]
            return
        held: list | None = []
        numbers = 0
        for f in self.fs.get_file_info(pa.fs.FileSelector(f"{self.root}/cell={cell}", recursive=True, allow_not_found=True)):
            if not f.path.endswith(".parquet"):
                continue
            for batch in pq.ParquetFile(self.fs.open_input_file(f.path)).iter_batches(PART, columns=["place", "embedding"]):
                v = _geometry(_matrix(batch.column("embedding"), self.dim), self.metric)
                fine = np.isfinite(v).all(1)
                part = batch.column("place").to_numpy()[fine], v[fine]
                numbers += part[1].size
                # A cell too large to be kept is read anew.
                held = [*held, part] if held is not None and numbers <= KEPT else None
                yield part
        if held is not None:
            while self.kept and self.numbers + numbers > KEPT:
                self.numbers -= sum(v.size for _, v in self.kept.pop(next(iter(self.kept))))
            self.kept[cell] = held
            self.numbers += numbers


def _short(v: np.ndarray) -> np.ndarray | None:
    """``v`` in single precision, none where its numbers or their products are too large for that."""
    return v.astype(np.float32) if len(v) and np.abs(v).max() < 1e15 else None


class _Nearest:
    """The ``k`` nearest vectors of a block of queries, as their distances and places."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.metric = q, metric
        self.half_q = (q * q).sum(1) / 2
        # Queries that are not finite are not compared.
        self.short = _short(np.where(np.isfinite(q).all(1)[:, None], q, 0))
        self.distance = np.full((len(q), k), np.inf)
        self.place = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, place: np.ndarray, v: np.ndarray) -> None:
        """Compare the queries ``rows`` with vectors. One product in single precision says which
        pairs can be near enough, within its largest error; the distances of those are computed one
        by one in double, so equal vectors tie."""
        k = self.distance.shape[1]
        euclidean = self.metric != "cosine"
        half = (v * v).sum(1) / 2
        short = None if self.short is None else _short(v)
        q, v_fast = (self.q, v) if short is None else (self.short, short)
        if len(rows) < len(q):
            q = q[rows]
        half_q = self.half_q[rows]
        own = half_q if euclidean else 1.0
        # The error of a product, from the lengths of both vectors; twice, as bounds are products too.
        error = 0.0 if short is None else 2 * (v.shape[1] + 16) * 2.0**-24
        for a in range(0, len(v), width := max(64, TILE // max(1, len(q)))):
            part = v[a : a + width]
            # Larger is nearer: half of |q|^2 - d^2, or 1 - d for cosine.
            score = q @ v_fast[a : a + width].T
            if euclidean:
                score -= half[a : a + width].astype(score.dtype)
            limit = self.distance[rows, -1]
            far = np.where(np.isfinite(limit), limit, 0)
            bound = own - (limit * limit / 2 if euclidean else limit)
            if part.shape[0] > k and np.isinf(limit).any():
                bound = np.maximum(bound, np.partition(score, -k, axis=1)[:, -k])
            most = half[a : a + width].max()
            slack = 1e-8 * (1 + own + far + (most if euclidean else 0))
            if short is not None:
                slack = slack + error * (2 * (half_q + most) + (far * far / 2 if euclidean else 1 + far)) + 1e-30
            # Rounded down, so what is compared is no higher than the bound.
            least = np.nextafter((bound - slack).astype(score.dtype), -np.inf, dtype=score.dtype)
            row, col = np.divmod(np.flatnonzero(score >= least[:, None]), part.shape[0])
            for b in range(0, len(row), step := max(1, TILE // self.q.shape[1])):
                r, c = rows[row[b : b + step]], col[b : b + step]
                if euclidean:
                    d = np.sqrt(np.square(self.q[r] - part[c]).sum(1))
                else:
                    d = 1.0 - (self.q[r] * part[c]).sum(1)
                self._merge(r, np.round(d, 9), place[a + c])

    def _merge(self, row: np.ndarray, distance: np.ndarray, place: np.ndarray) -> None:
        k = self.distance.shape[1]
        fine = distance <= self.distance[row, -1]
        rows, at = np.unique(row[fine], return_inverse=True)
        r = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
        d = np.concatenate([self.distance[rows].ravel(), distance[fine]])
        p = np.concatenate([self.place[rows].ravel(), place[fine]])
        order = np.lexsort((p, d, r))
        r = r[order]
        kept = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
        self.distance[rows], self.place[rows] = d[kept].reshape(-1, k), p[kept].reshape(-1, k)


def _searched(index: VectorIndex, queries: DataFrame, k: int, probe: int | None) -> DataFrame:
    """(query_id, place, distance) of the ``k`` nearest vectors of each query row. Queries are dealt
    by their nearest cell; a task holds a block of them and reads the cells that can matter."""
    spark = index.spark
    path = f"{index.path}/vectors"
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    dim, metric = index.dim, index.metric
    cell, centre, radius, size = index.cell, index.centre, index.radius, index.n

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _geometry(_matrix(batch.column("embedding"), dim), metric)
            near = [_distances(q[a : a + PART], centre, "l2").argmin(1) for a in range(0, len(q), PART)]
            column = pa.array(np.concatenate(near) if near else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "home"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(uri, dim, metric)
        for whole in batches:
            for a in range(0, whole.num_rows, PART):
                batch = whole.slice(a, PART)
                found = block(cells, _geometry(_matrix(batch.column("embedding"), dim), metric))
                row, at = np.nonzero(np.isfinite(found.distance))
                columns = [pa.array(found.place[row, at]), pa.array(found.distance[row, at])]
                ids = batch.column("query_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["query_id", "place", "distance"])

    def block(cells: _Cells, q: np.ndarray) -> _Nearest:
        found = _Nearest(q, k, metric)
        away = _distances(q, centre, "l2")
        first = _first_cells(size, away, k, probe)
        sound = np.isfinite(q).all(1)
        # The nearest cells give a distance within which k vectors lie; others are read where they can hold a nearer one.
        for chosen in (first,) if probe else (first, ~first):
            for at in np.argsort(away.min(0), kind="stable").tolist():
                near = _reached(away[:, at] - radius[at], found.distance[:, -1], metric)
                rows = np.flatnonzero(sound & chosen[:, at] & near)
                if len(rows):
                    for place, v in cells.read(int(cell[at])):
                        found.add(rows, place, v)
        return found

    fields = [queries.schema[c] for c in ("query_id", "embedding")]
    placed = queries.mapInArrow(home, T.StructType(fields).add("home", "integer"))
    n = queries.count()
    tasks = max(1, min(-(-n // 256), max(2 * spark.sparkContext.defaultParallelism, -(-n // TASK))))
    dealt = placed.repartitionByRange(tasks, "home", F.xxhash64("query_id")).sortWithinPartitions("home")
    return dealt.drop("home").mapInArrow(search, T.StructType(fields[:1]).add("place", "long").add("distance", "double"))


def nearest_written(index: VectorIndex, queries: DataFrame, k: int, probe: int | None = None) -> DataFrame:
    """``query_id``, chunk key, distance and rank of the ``k`` nearest vectors of each query.

    Exact: the nearest cells give a distance within which ``k`` vectors lie, then the cells that
    can hold a nearer one are read; where cells rule out nothing, every query meets every vector.
    With ``probe`` only that many nearest cells of a query are read, which may miss some;
    :func:`recall` tells how many. Query ids are unique.
    """
    spark = index.spark
    if index.empty:
        fields = queries.select("query_id").schema.add("entity_id", "string").add("distance", "double").add("rank", "integer")
        return spark.createDataFrame([], fields)
    asked = S.conforming_vectors(queries, index.dim).select("query_id", "embedding")
    keys = broadcast_if_small(index.vectors.select("place", *index.key), S.SMALL_ROWS)
    found = _searched(index, asked, k, probe).join(keys, "place").select("query_id", *index.key, "distance")
    return S.best_k(found, k, [F.col("distance"), *map(F.col, index.key)])


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: ``recall``, the share of the rows of ``exact`` that ``found`` has."""
    key = ["query_id", *S.chunk_key(exact)]
    hit = found.select(*key).withColumn("_hit", F.lit(1))
    return exact.join(hit, key, "left").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))

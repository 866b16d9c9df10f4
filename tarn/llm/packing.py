"""Packing documents into token sequences by non-negative least squares."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.batches import slices
from tarn.llm.tokens import default_path, encoder
from tarn.session import durable

WINDOW = 1024
#: Lengths in a combination, and iterations of the solver.
DEPTH = 3
STEPS = 400
#: A greedy sequence may be padded by this share of the window; what cannot be packed so is cut.
SLACK = 1 / 64
#: Rows that are ranked together.
RANKED = 4_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tail binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(n, DEPTH) ascending lengths that fill the window exactly; 0 where fewer are used."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [np.column_stack([np.zeros((0, DEPTH), np.int64)])]
    a = lengths
    b = window - a
    pair = (b >= a) & have[np.maximum(b, 0)]
    out.append(np.column_stack([np.zeros(pair.sum(), np.int64), a[pair], b[pair]]))
    x, y = np.meshgrid(lengths, lengths, indexing="ij")
    z = window - x - y
    triple = (x <= y) & (y <= z)
    triple &= have[np.clip(z, 0, window)]
    out.append(np.column_stack([x[triple], y[triple], z[triple]]))
    return np.concatenate(out).astype(np.int64)


def least_squares(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the combinations that minimise |A x - counts|**2, where A counts the
    lengths of each combination. Accelerated projected gradient; A is never formed."""
    if not len(combos):
        return np.zeros(0)
    n = len(counts)
    used = combos > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), (x[:, None] * used).ravel(), n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * used).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(forward(v / np.linalg.norm(v)))
    step = 1 / (1.1 * np.linalg.norm(v))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(y - step * back(forward(y) - counts), 0)
        faster = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / faster * (after - x)
        x, t = after, faster
    return x


@dataclass
class Plan:
    """Where the pieces of each length go, by their rank among the pieces of that length.

    A slot takes ranks [first, last) of a length, ``each`` per sequence, from ``sequence`` on
    and from ``offset`` in it. Ranks from ``used[length]`` on are laid end to end from
    ``pooled[length]`` in a stream that is cut into sequences from ``pool_sequence`` on.
    """

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    pooled: np.ndarray
    pool_sequence: int
    n_sequences: int


def make_plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """A plan for ``counts[length]`` pieces of each length below ``window``.

    Least squares over exact fillings first, rounded and cut back to what there is; then
    greedily, the largest piece and the largest that fit beside it. Its size depends on
    the window alone.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(window, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    n_sequences = 0

    def take(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal n_sequences
        offset = 0
        for length, each in parts:
            slots.append((length, int(used[length]), each, n_sequences, offset))
            used[length] += each * times
            left[length] -= each * times
            offset += length * each
        n_sequences += times

    combos = combinations(np.flatnonzero(counts > 0), window)
    repeats = np.rint(least_squares(combos, counts.astype(float))).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] <= 0:
            break
        lengths, each = np.unique(combos[i][combos[i] > 0], return_counts=True)
        times = min(int(repeats[i]), int((left[lengths] // each).min()))
        if times > 0:
            take(list(zip(lengths.tolist()[::-1], each.tolist()[::-1], strict=True)), times)

    pool = np.zeros(window, np.int64)
    slack = int(window * SLACK)
    while left.any():
        parts: list[tuple[int, int]] = []
        gap = window
        free = left.copy()
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            each = int(min(free[length], gap // length))
            parts.append((length, each))
            gap -= each * length
            free[length] = 0
        if gap > slack:
            largest = parts[0][0]
            pool[largest] += left[largest]
            left[largest] = 0
        else:
            take(parts, int(min(left[length] // each for length, each in parts)))
    sizes = pool * np.arange(window)
    pooled = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    columns = np.array(slots, np.int64).reshape(-1, 5)
    order = np.lexsort((columns[:, 1], columns[:, 0]))
    length, first, each, sequence, offset = columns[order].T
    total = n_sequences + -(-int(sizes.sum()) // window)
    return Plan(length, first, each, sequence, offset, used, pooled, n_sequences, total)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces whose rank is below ``plan.used``."""
    wide = np.int64(1) << 44
    at = np.searchsorted(plan.length * wide + plan.first, length * wide + rank, "right") - 1
    within = rank - plan.first[at]
    return plan.sequence[at] + within // plan.each[at], plan.offset[at] + within % plan.each[at] * length


def cut_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces (``PIECES``) of at most ``window`` ids of every document; a piece that does not
    fill the window keeps its ids in ``tail``."""
    model = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for rows, data, at in slices(batches):
            coder = coder or encoder(model)
            ids, offsets = coder.encode_bytes(data, at)
            sizes = np.diff(offsets)
            n_pieces = -(-sizes // window)
            owner = np.repeat(np.arange(len(sizes)), n_pieces)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = k * window
            length = np.minimum(sizes[owner] - start, window)
            wide = ids.astype("<u4")
            small = ids.astype(coder.id_type)
            crc, tail = [], []
            for a, n in zip((offsets[owner] + start).tolist(), length.tolist(), strict=True):
                crc.append(zlib.crc32(wide[a : a + n].tobytes()))
                tail.append(small[a : a + n].tobytes() if n < window else None)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()).take(pa.array(owner)),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(sizes[owner], pa.int64()),
                    pa.array(tail, pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tail"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """``PACKED`` rows: which piece of which document lies where in which sequence.

    The histogram of lengths, one number for each length below the window, is all that
    reaches the driver. Pieces are ranked within their length in salted groups, so copies
    that share a length are spread; the plan then places each by its rank.

    A null or empty text is the end id alone. Repeated rows are each packed, null ids too.
    An empty table gives no sequences. Every sequence but the last of the cut ones is filled
    up to ``SLACK`` of the window.
    """
    pieces = durable(cut_documents(docs, tokenizer, window).withColumn("uid", F.monotonically_increasing_id()))
    tails = pieces.where(F.col("length") < window)
    histogram = {r["length"]: r["count"] for r in tails.groupBy("length").count().collect()}
    counts = np.zeros(window, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = make_plan(counts, window)

    salts = max(1, -(-int(counts.sum()) // RANKED))
    salted = tails.drop("tail").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    ranked = salted.withColumn("local", local).join(groups, ["length", "salt"])
    ranked = durable(ranked.withColumn("rank", F.col("before") + F.col("local")).drop("before", "local", "salt"))
    used = F.element_at(F.lit(plan.used.tolist()), (F.col("length") + 1).cast("int"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = place(plan, length, rank)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                n, at = r["length"], int(plan.pooled[r["length"]] + (r["rank"] - plan.used[r["length"]]) * r["length"])
                ids = np.frombuffer(r["tail"], f"<u{len(r['tail']) // n}").astype("<u4")
                done = 0
                while done < n:
                    offset = (at + done) % window
                    size = min(n - done, window - offset)
                    crc = zlib.crc32(ids[done : done + size].tobytes())
                    sequence = plan.pool_sequence + (at + done) // window
                    out.append((r["doc_id"], r["start"] + done, size, crc, r["doc_tokens"], sequence, offset))
                    done += size
                if len(out) >= 10_000:
                    yield _packed(out)
                    out = []
        if out:
            yield _packed(out)

    whole = ranked.where(F.col("rank") < used).mapInArrow(settle, PACKED) if len(plan.length) else None
    pooled = ranked.where(F.col("rank") >= used)
    pooled = pooled.join(tails.select("uid", "tail"), "uid").drop("uid").mapInArrow(cut, PACKED)
    full = pieces.where(F.col("length") == window).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.monotonically_increasing_id() + plan.n_sequences).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    out = full.union(pooled)
    return out.union(whole) if whole is not None else out


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

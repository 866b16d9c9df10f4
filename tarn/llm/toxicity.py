"""Toxic documents by a classifier chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.llm.batches import lower_ascii, prefix_hash, slices, substring_hash, word_bounds
from tarn.session import durable

#: The chain, in order. The first two are read off the labelled documents with the terms
#: that the labels single out: whether several such terms occur, and whether they are dense.
CATEGORIES = ("hostile_terms", "hostile_density", "toxic")
#: Most labelled rows that the models are fitted on: those with the smallest hash of the id.
MAX_LABELLED = 8_000
TERMS = 64
MIN_DOCUMENTS = 5
FOLDS = 5
THRESHOLD = 0.5


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 0x80)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every lower-cased run of letters and digits."""
    data = lower_ascii(data)
    start, end, row = word_bounds(data, offsets, _letters(data))
    return substring_hash(prefix_hash(data), start, end), row


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        term, row = _terms(data, offsets)
        toxic = rows.column("toxic").to_numpy(zero_copy_only=False)
        order = np.lexsort((term, row))
        term, row = term[order], row[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(term[new].view(np.int64)), pa.array(toxic[row[new]], pa.int32())], names=["term", "toxic"]
        )


def _features(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Rows of: log counts of the sorted ``terms``, the log of all of them, and their share."""
    term, row = _terms(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, len(terms) + 3))
    if len(terms):
        at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
        hit = terms[at] == term
        counts = np.bincount(row[hit] * len(terms) + at[hit], minlength=n * len(terms)).reshape(n, -1)
        words = np.maximum(np.bincount(row, minlength=n), 1)
        out[:, : len(terms)] = np.log1p(counts)
        out[:, -3] = np.log1p(counts.sum(axis=1))
        out[:, -2] = np.log1p((counts > 0).sum(axis=1))
        out[:, -1] = np.minimum(100 * counts.sum(axis=1) / words, 20)
    return out


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant's."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = _probability(x, w)
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _probability(np.column_stack([x, np.ones(len(x))]), w)


def fit_chain(x: np.ndarray, targets: list[np.ndarray], fold: np.ndarray) -> list[np.ndarray]:
    """One linear model for each category. A later one also sees the probabilities of the
    earlier ones; in training these come from models that did not see the row's fold."""
    chain = []
    for y in targets:
        chain.append(_fit(x, y))
        held_out = np.empty(len(y))
        for k in range(FOLDS):
            out = fold == k
            if out.any():
                held_out[out] = _predict(x[out], _fit(x[~out], y[~out]))
        x = np.column_stack([x, held_out])
    return chain


def run_chain(x: np.ndarray, chain: list[np.ndarray]) -> np.ndarray:
    """(rows, categories) probabilities."""
    out = []
    for w in chain:
        out.append(_predict(x, w))
        x = np.column_stack([x, out[-1]])
    return np.column_stack(out) if out else np.zeros((len(x), len(CATEGORIES)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """(terms, chain) learned from at most ``MAX_LABELLED`` labelled documents.

    Terms are chosen by Spark, by how much more often toxic documents hold them. What
    reaches the driver is at most MAX_LABELLED rows of TERMS + 3 numbers. Without labels of
    both kinds the chain is empty and every probability 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
    sample = durable(sample)  # at most MAX_LABELLED rows
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return np.empty(0, np.uint64), []
    held = sample.mapInArrow(_distinct_terms, "term long, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    ratio = ((F.col("bad") + 0.5) / (sizes[1] + 1)) / ((F.col("good") + 0.5) / (sizes[0] + 1))
    # Evidence: how far and how often the term leans to toxic documents.
    held = held.where(F.col("bad") >= MIN_DOCUMENTS).select("term", (F.log(ratio) * F.sqrt("bad")).alias("lean"))
    chosen = held.where("lean > 0").orderBy(F.desc("lean"), "term").limit(TERMS).collect()
    if not chosen:
        return np.empty(0, np.uint64), []
    best = chosen[0]["lean"]
    terms = np.array([r["term"] for r in chosen if r["lean"] > best / 4], np.int64).view(np.uint64)
    terms = np.sort(terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            x = _features(data, offsets, terms)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("toxic"), flat.cast(pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "x"],
            )

    rows = sample.mapInArrow(features, "doc_id long, toxic int, x array<double>").orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    several = ((x[:, -2] >= np.log1p(2)) & (y > 0)).astype(float)
    dense = ((x[:, -1] >= np.median(x[y > 0, -1])) & (y > 0)).astype(float)
    fold = np.arange(len(y)) % FOLDS
    return terms, fit_chain(x, [several, dense, y], fold)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with p_hostile_terms, p_hostile_density, p_toxic
    and is_toxic.

    Null and empty texts have no terms and get the probabilities of a text without any.
    Repeated rows get equal answers. Labels may be few, repeated (the worse counts), null
    (ignored) or of unknown documents (ignored). Columns of ``docs`` named like the added
    ones are replaced. The decision is a projection: no row is shuffled.
    """
    added = [*(f"p_{c}" for c in CATEGORIES), "is_toxic"]
    docs = docs.drop(*added)
    terms, chain = train(docs, labels)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            p = run_chain(_features(data, offsets, terms), chain)
            columns = [pa.array(p[:, k]) for k in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *columns, pa.array(p[:, -1] >= THRESHOLD)], names=[*rows.schema.names, *added]
            )

    schema = StructType(list(docs.schema.fields))
    for name in added[:-1]:
        schema = schema.add(name, "double")
    return docs.mapInArrow(decide, schema.add("is_toxic", "boolean"))

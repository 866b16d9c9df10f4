"""Words in passages that documents share, by window hashes that meet at anchors.

A window is a number of neighbouring words. Equal windows have the same anchor, the least hash
of the short word sequences inside them; neighbouring windows with one anchor are a segment.
Segments whose anchor is found in one document only go no further; equal segments are one row
for each task, and only windows of segments that meet different ones are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import gram_hash, powers, prefix_hash, slices, substring_hash, word_bounds
from tarn.session import durable

WORDS = 50
#: Words of the sequences whose hashes are anchors.
GRAM = 8
#: Word places whose least hashes are found at once, at least; a place takes so many low bits.
CHUNK_BITS = 16

SEGMENTS = "meet long, piece long, row long, key long, doc_name long, first int, size int"


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` neighbouring hashes the place of the leftmost of the least."""
    n = max(0, len(hashes) - width + 1)
    out = np.empty(n, np.int64)
    bits = max(CHUNK_BITS, (2 * width).bit_length())
    step = (1 << bits) - width
    low = np.uint64((1 << bits) - 1)
    for start in range(0, n, step):
        part = hashes[start : start + step + width - 1]
        count = len(part) - width + 1
        best = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        best = np.minimum(best[:count], best[width - span : width - span + count])
        out[start : start + count] = (best & low).astype(np.int64) + start
    return out


def _word_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, running hash of the words)."""
    start, end, row = word_bounds(data, offsets)
    prefix = np.zeros(len(start) + 1, np.uint64)
    each = substring_hash(prefix_hash(data), start, end)
    np.cumsum(each * powers(len(prefix))[0][: len(each)], out=prefix[1:])
    return row, prefix


def _segments(words: int):
    """Runs of neighbouring windows with one anchor, in every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            row, prefix = _word_prefix(data, offsets)
            if len(row) < words:
                continue
            anchor = gram_hash(prefix, GRAM)
            place = least_places(anchor, words - GRAM + 1)
            window = np.flatnonzero(row[: len(place)] == row[words - 1 :])
            if not len(window):
                continue
            opens = np.append(True, (np.diff(window) != 1) | (np.diff(place[window]) != 0))
            first = window[opens]
            size = np.diff(np.append(np.flatnonzero(opens), len(window)))
            piece = substring_hash(prefix, first, first + size + words - 1)
            home = row[first]
            named = [rows.column(c).take(pa.array(home)) for c in ("row", "key", "doc_name")]
            places = first - np.searchsorted(row, home)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[place[first]].view(np.int64)), pa.array(piece.view(np.int64)), *named,
                    pa.array(places, pa.int32()), pa.array(size, pa.int32()),
                ],
                names=["meet", "piece", "row", "key", "doc_name", "first", "size"],
            )

    return cut


def window_hashes(
    wanted: pa.ListArray, data: np.ndarray, offsets: np.ndarray, words: int = WORDS
) -> dict[str, pa.Array]:
    """Columns meet, piece, low, high, at and window: hashes of all windows of the wanted segments of each text."""
    row, prefix = _word_prefix(data, offsets)
    flat = wanted.flatten()
    home = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
    first = flat.field("first").to_numpy() + np.searchsorted(row, home)
    size = flat.field("size").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    start = first[owner] + at
    window = substring_hash(prefix, start, start + words).view(np.int64)
    same = {c: flat.field(c).take(pa.array(owner)) for c in ("meet", "piece", "low", "high")}
    return same | {"at": pa.array(at, pa.int32()), "window": pa.array(window)}


def shared_segments(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (key, doc_name, text): all segments whose anchor several rows hold, and the distinct ones.

    A row is read as words, runs of bytes that are not ASCII white space.
    """
    if words <= GRAM:
        raise ValueError(f"windows must be longer than {GRAM} words")
    numbered = docs.select("key", "doc_name", "text").withColumn("row", F.monotonically_increasing_id())
    segments = durable(numbered.mapInArrow(_segments(words), SEGMENTS))
    places = segments.groupBy("meet").agg(
        F.min("row").alias("r0"), F.max("row").alias("r1"), (F.min("piece") != F.max("piece")).alias("mixed")
    )
    # Written, so that the join reads shuffled rows on both sides and a hot anchor can be split.
    places = durable(places.where("r0 != r1").select("meet", "mixed"))
    met = durable(segments.join(places, "meet"))
    one = [F.min_by(c, "row").alias(c) for c in ("key", "doc_name", "first")]
    pieces = met.groupBy("meet", "piece", "mixed", "size").agg(F.min("row").alias("low"), F.max("row").alias("high"), *one)
    return met, durable(pieces)


def wanted_segments(pieces: DataFrame) -> DataFrame:
    """(key, doc_name, v): the distinct segments whose windows must be compared, and a text that holds each."""
    v = F.struct("meet", "piece", "low", "high", "first", "size")
    return pieces.where("mixed").select("key", "doc_name", v.alias("v"))


def shared_windows(met: DataFrame, pieces: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, doc_name, starts): the word places of each text where a window starts that another row holds too.

    ``met`` and ``pieces`` are of ``shared_segments``, ``windows`` has the ``window_hashes`` of the wanted ones.
    Places may come twice.
    """
    # Segments that several rows hold are shared from end to end.
    whole = pieces.where("low != high").select("meet", "piece", F.sequence(F.lit(0), F.col("size") - 1).alias("starts"))
    twice = windows.groupBy("meet", "window").agg(F.min("low").alias("r0"), F.max("high").alias("r1")).where("r0 != r1")
    some = windows.where("low = high").join(twice, ["meet", "window"])
    some = some.groupBy("meet", "piece").agg(F.collect_list("at").alias("starts"))
    runs = durable(whole.unionByName(some))
    hits = met.select("meet", "piece", "key", "doc_name", "first").join(runs, ["meet", "piece"])
    moved = F.transform("starts", lambda s: s + F.col("first"))
    return hits.groupBy("key", "doc_name").agg(F.flatten(F.collect_list(moved)).alias("starts"))


def covered(starts: np.ndarray, words: int = WORDS) -> int:
    """How many words the windows at ``starts`` hold."""
    starts = np.sort(starts)
    return int(np.minimum(np.diff(starts), words).sum()) + words if len(starts) else 0

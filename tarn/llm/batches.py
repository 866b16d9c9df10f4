"""Arrow batches as flat numpy arrays: text bytes, words, word and shingle hashes.

Everything here works on whole columns at once; a batch is cut into slices of a few
megabytes of text, so memory does not depend on Spark's batch size.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def held(module: str, key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each Python worker and kept for its later tasks.

    This package travels to the workers by value, anew for every task, so the object hangs on
    ``module``, a library that the worker has imported.
    """
    shelf = importlib.import_module(module).__dict__.setdefault("_tarn_held", {})
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is the empty text."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0 or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most ``limit`` bytes of text, or of one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows, start + 20_000)
            yield (
                batch.slice(start, end - start),
                data[offsets[start] : offsets[end]],
                offsets[start : end + 1] - offsets[start],
            )
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, _U)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=_U))
        del _powers[:-2]
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``substring_hash`` takes differences of it."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_SYMBOL[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], wherever it lies."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """``substring_hash`` of every string of ``size``, without an index for each."""
    n = max(0, len(prefix) - size)
    raw = (prefix[size:] - prefix[:n]) * powers(len(prefix))[1][:n]
    return mix(raw + _U(size * 0xD6E8FEB86659FD93 % (1 << 64)))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words: runs of bytes that are ``inside`` one, by default
    that are not ASCII white space."""
    inside = ~is_space(data) if inside is None else inside
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets[:-1]] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    closes = np.zeros(len(data) + 1, bool)
    closes[offsets[1:]] = True
    end = np.flatnonzero(inside & (~after | closes[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    start, end, row = word_bounds(data, offsets)
    return substring_hash(prefix_hash(data), start, end), row


def row_starts(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Where the items of each row begin; one more for the end."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def shingles(words: np.ndarray, starts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles of each row.

    A row with fewer words has its whole word sequence as one; a row without words none.
    """
    factors = mix(np.arange(1, width + 1, dtype=_U))
    n = len(words)
    full = np.zeros(max(n - width + 1, 0), _U)
    for k in range(width):
        full += words[k : k + len(full)] * factors[k]
    full = mix(full)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            whole = (words[a:b] * factors[: b - a]).sum(dtype=_U) + _U(b - a)
            out.append(mix(np.array([whole], _U)))
        else:
            out.append(np.empty(0, _U))
    return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

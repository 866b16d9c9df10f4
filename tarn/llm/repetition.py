"""Quality rules on repetition, by suffix arrays of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tarn.llm.batches import prefix_hash, row_starts, slices, substring_hash, word_bounds
from tarn.llm.suffixes import longest_matches, suffix_ranks

MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED = 20
#: A maximal repeated substring counts from this many words on.
MIN_REPEAT = 8
#: Percent of the words that such substrings may cover, and words in the longest one.
MAX_COVERED = 18
MAX_LONGEST = 60
SYMBOLS = b"#*$%&|<>"

LONGS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_repeats", "covered_words", "longest_repeat",
)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    home = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    row = np.concatenate([np.arange(n), home])
    start = start[np.lexsort((start, row))]
    row_end = np.concatenate([home, np.arange(n)])
    end = end[np.lexsort((end, row_end))]
    row = np.sort(row)
    real = np.searchsorted(words, end) > np.searchsorted(words, start)
    start, end, row = start[real], end[real], row[real]
    name = substring_hash(prefix, start, end)
    order = np.lexsort((name, row))
    again = (name[order][1:] == name[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=n)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of each row, as named in ``LONGS``."""
    n = len(offsets) - 1
    prefix = prefix_hash(data)
    start, end, row = word_bounds(data, offsets)
    starts = row_starts(row, n)
    match = longest_matches(suffix_ranks(substring_hash(prefix, start, end), row), row)
    at = np.flatnonzero(match >= WINDOW)
    repeated = _covered(at, np.full(len(at), WINDOW), len(row))
    at = np.flatnonzero(match >= MIN_REPEAT)
    covered = _covered(at, match[at], len(row))
    # A repeat is maximal on the left where the suffix before does not already hold it.
    before = np.zeros(len(row), np.int64)
    before[1:] = np.where(row[1:] == row[:-1], match[:-1], 0)
    maximal = (match >= MIN_REPEAT) & (before <= match)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, match)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    in_word = np.cumsum(inside[:-1]) > 0
    return {
        "n_words": np.diff(starts),
        "word_chars": _sums(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets),
        "n_dup_lines": _duplicate_lines(data, offsets, prefix, start),
        "n_repeat_words": _sums(repeated, starts),
        "n_repeats": _sums(maximal, starts),
        "covered_words": _sums(covered, starts),
        "longest_repeat": np.where(longest >= MIN_REPEAT, longest, 0),
    }


def repetition_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (text and others) with the figures in ``LONGS``, base_failed and kept.

    For each text a suffix array of its words is built; intervals of longest common
    prefixes give the maximal repeated substrings. Those of ``MIN_REPEAT`` words and more
    may cover ``MAX_COVERED`` percent of the words and may be ``MAX_LONGEST`` words long. Null and empty texts
    have no words and fail the base rules. A text is one row's work, near linear in its
    length. Columns of ``docs`` named like the added ones are replaced; no row is shuffled.
    """
    added = [*LONGS, "base_failed", "kept"]
    docs = docs.drop(*added)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            m = measure(data, offsets)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
            kept = ~failed & (100 * m["covered_words"] <= MAX_COVERED * m["n_words"])
            kept &= m["longest_repeat"] <= MAX_LONGEST
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *(pa.array(m[c], pa.int64()) for c in LONGS), pa.array(failed), pa.array(kept)],
                names=[*rows.schema.names, *added],
            )

    schema = StructType(list(docs.schema.fields))
    for name in LONGS:
        schema = schema.add(name, "long")
    return docs.mapInArrow(judge, schema.add("base_failed", "boolean").add("kept", "boolean"))


def _windows(size: int, name: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, pos, i.n >= pos + {size - 1} AND count(*) OVER (
           PARTITION BY doc_id, CASE WHEN i.n >= pos + {size - 1} THEN ws[pos:pos + {size - 1}] END) > 1 AS again
  FROM placed i),
{name}_sum AS (
  SELECT doc_id, count(*) FILTER (hit) AS words, bool_or(hit) AS any_hit FROM (
    SELECT doc_id, bool_or(again) OVER (
      PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS hit
    FROM {name}) GROUP BY doc_id)"""


SQL = rf"""
WITH split_words AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS pos FROM split_words),
{_windows(WINDOW, "five")},
{_windows(MIN_REPEAT, "runs")},
{_windows(MAX_LONGEST + 1, "over")},
dup AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(five_sum.words, 0) AS n_repeat_words,
         coalesce(runs_sum.words, 0) AS covered_words, coalesce(over_sum.any_hit, false) AS too_long
  FROM split_words w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN five_sum ON w.doc_id = five_sum.doc_id
  LEFT JOIN runs_sum ON w.doc_id = runs_sum.doc_id LEFT JOIN over_sum ON w.doc_id = over_sum.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
       AND 100 * covered_words <= {MAX_COVERED} * n_words AND NOT too_long AS kept
FROM base
"""

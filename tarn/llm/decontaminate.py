"""Benchmark passages in documents, by Wu-Manber search for many patterns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tarn.llm.batches import lists, slices, utf8, word_bounds
from tarn.session import durable

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Bytes of a shift block, and of the slot numbers that blocks are hashed to.
BLOCK = 8
SLOT_BITS = 20
#: Positions that one search lane walks over.
LANE = 512
#: Pairs of a position and a test string that are compared together.
PAIRS = 1 << 20
#: Bytes of benchmark text searched for in one pass over the documents.
PASS_BYTES = 4 << 20
#: Words of a part of an item; parts overlap by a window less one word.
PART_WORDS = 4096
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SPACE, _END = 0x20, 0x0A
_TABLE = np.full(256, _SPACE, np.uint8)
for _a, _b, _shift in ((0x30, 0x3A, 0), (0x61, 0x7B, 0), (0x80, 0x100, 0), (0x41, 0x5B, 0x20)):
    _TABLE[_a:_b] = np.arange(_a, _b) + _shift
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Rows of text as one run of bytes: `` w1 w2 ... wn `` and an end mark for each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = _TABLE[data]
        start, end, row = word_bounds(lower, offsets, lower != _SPACE)
        sizes = end - start
        self.counts = np.bincount(row, minlength=len(offsets) - 1)
        # Each word follows one space, and each row adds a space and the end mark.
        moved = np.arange(len(row)) + 2 * row + 1
        self.start = np.cumsum(sizes) - sizes + moved
        self.n = int(sizes.sum()) + len(row) + 2 * (len(offsets) - 1)
        self.text = np.full(self.n + BLOCK, _END, np.uint8)
        self.text[: self.n] = _SPACE
        row_words = np.concatenate([[0], np.cumsum(self.counts)])
        self.first_word = row_words[:-1]
        before = np.concatenate([[0], np.cumsum(sizes)])[row_words]
        self.row_end = before[1:] + row_words[1:] + 2 * np.arange(1, len(offsets)) - 1
        self.text[self.row_end] = _END
        inside = np.repeat(moved, sizes) + np.arange(int(sizes.sum()))
        self.text[inside] = lower[lower != _SPACE]
        self.row = row

    def eights(self) -> np.ndarray:
        """The eight bytes from each position on, as one number; a view."""
        return np.ndarray((self.n,), "<u8", self.text.data, 0, (1,))


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


class Strings:
    """Test strings of about equal length: their shift table and suffix buckets.

    ``start`` and ``size`` cut them out of ``source``; ``window`` numbers them. Only the first
    ``m`` bytes, as many as the shortest has, make up the tables.
    """

    def __init__(self, source: np.ndarray, start: np.ndarray, size: np.ndarray, window: np.ndarray):
        self.m = int(size.min())
        self.block = min(BLOCK, self.m)
        self.lead = self.m - self.block
        self.mask = _mask(self.block)
        self.shift = np.full(1 << SLOT_BITS, self.lead + 1, np.int64)
        for j in range(self.lead + 1):
            # Later blocks shift less and overwrite earlier ones.
            self.shift[self.slots(source[start + j])] = self.lead - j
        suffix = source[start + self.lead] & self.mask
        order = np.argsort(suffix, kind="stable")
        self.source, self.start, self.size, self.window = source, start[order], size[order], window[order]
        self.suffix, self.bucket = np.unique(suffix[order], return_index=True)
        self.bucket = np.append(self.bucket, len(order))

    def slots(self, eights: np.ndarray) -> np.ndarray:
        return ((eights & self.mask) * _MULTIPLIER) >> np.uint64(64 - SLOT_BITS)

    def _ends(self, text: np.ndarray) -> np.ndarray:
        """Positions of blocks that end the first ``m`` bytes of some string. Lanes of
        positions are walked side by side; every lane skips by its own shift."""
        at = np.arange(self.lead, len(text) - self.block + 1, LANE)
        stop = np.append(at[1:], max(len(text) - self.block + 1, 0))[: len(at)]
        found = []
        while len(at):
            skip = self.shift[self.slots(text[at])]
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def occurrences(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, string) of all occurrences, confirmed byte by byte, a bounded number of
        pairs at a time."""
        ends = self._ends(text)
        key = text[ends] & self.mask
        at = np.minimum(np.searchsorted(self.suffix, key), len(self.suffix) - 1)
        hit = self.suffix[at] == key
        ends, low, high = ends[hit] - self.lead, self.bucket[at[hit]], self.bucket[at[hit] + 1]
        done = np.cumsum(high - low)
        total = int(done[-1]) if len(done) else 0
        for a in range(0, total, PAIRS):
            pair = np.arange(a, min(a + PAIRS, total))
            owner = np.searchsorted(done, pair, "right")
            string = low[owner] + pair - (done[owner] - (high - low)[owner])
            yield self._confirmed(text, ends[owner], string)

    def _confirmed(self, text: np.ndarray, at: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fits = at + self.size[string] <= len(text)
        at, string = at[fits], string[fits]
        step = 0
        whole = []
        while len(at):
            left = self.size[string] - step
            mask = np.where(left >= 8, _mask(8), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
            same = (text[at + step] ^ self.source[self.start[string] + step]) & mask == 0
            at, string, left = at[same], string[same], left[same]
            whole.append((at[left <= 8], string[left <= 8]))
            at, string = at[left > 8], string[left > 8]
            step += 8
        if not whole:
            return at, string
        return np.concatenate([x for x, _ in whole]), np.concatenate([x for _, x in whole])


class Benchmark:
    """The windows of a block of items, grouped by length, ready to be searched for."""

    def __init__(self, ids: list[str], texts: pa.Array):
        words = Words(*utf8(texts))
        eights = words.eights()
        total = words.counts
        # Every word opens a window if enough words follow it in its row, or the row is short.
        within = np.arange(len(words.row)) - words.first_word[words.row]
        opens = np.flatnonzero((within + WINDOW <= total[words.row]) | (within == 0))
        n_words = np.minimum(total[words.row[opens]], WINDOW)
        last = opens + n_words - 1
        start = words.start[opens] - 1
        follow = np.append(words.start[1:], 0)
        is_last = within[last] + 1 == total[words.row[last]]
        end = np.where(is_last, words.row_end[words.row[last]], follow[last])
        size = end - start
        window = self._distinct(words.text, start, size)
        _, first = np.unique(window, return_index=True)
        owners = sorted({(w, ids[r]) for w, r in zip(window.tolist(), words.row[opens].tolist(), strict=True)})
        self.owner_at = np.searchsorted(np.array([w for w, _ in owners], np.int64), np.arange(len(first) + 1))
        self.owners = [i for _, i in owners]
        self.n_words = n_words[first]
        start, size = start[first], size[first]
        group = np.log2(size).astype(int) if len(size) else size
        self.groups = [
            Strings(eights, start[at], size[at], at) for g in np.unique(group) if len(at := np.flatnonzero(group == g))
        ]

    @staticmethod
    def _distinct(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Equal windows get equal numbers 0, 1, 2, ..."""
        raw = text.tobytes()
        seen: dict[bytes, int] = {}
        return np.array(
            [seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(start.tolist(), size.tolist(), strict=True)], np.int64
        )

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, window) of every occurrence."""
        text = words.eights()
        found = []
        for group in self.groups:
            for at, string in group.occurrences(text):
                window = group.window[string]
                first = np.searchsorted(words.start, at + 1)
                found.append((first, first + self.n_words[window], window))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(mark: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the maximal runs of marked words of a row."""
    edge = np.append(True, row[1:] != row[:-1]) if len(row) else np.empty(0, bool)
    before = np.append(False, mark[:-1]) & ~edge if len(row) else mark
    after = np.append(mark[1:], False) & ~np.append(edge[1:], True) if len(row) else mark
    return np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after)


def _search(docs: DataFrame, ids: list[str], texts: pa.Array) -> DataFrame:
    """``docs`` with the hits of these items added to its columns ``hits`` and ``items``."""
    sent = docs.sparkSession.sparkContext.broadcast((ids, texts))
    again = "hits" in docs.columns
    added = ["n_words", "hits", "items"]
    kept = [c for c in docs.columns if c not in added]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = None
        for rows, data, offsets in slices(batches):
            benchmark = benchmark or Benchmark(*sent.value)
            words = Words(data, offsets)
            n = rows.num_rows
            first, stop, window = benchmark.find(words)
            edge = np.zeros(len(words.row) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, stop, -1)
            mark = np.cumsum(edge[:-1]) > 0
            items: list[set[str]] = [set() for _ in range(n)]
            pairs = np.unique(np.stack([words.row[first], window]), axis=1) if len(first) else np.empty((2, 0), np.int64)
            for r, w in pairs.T.tolist():
                items[r].update(benchmark.owners[benchmark.owner_at[w] : benchmark.owner_at[w + 1]])
            if again:
                for r, (spans, more) in enumerate(
                    zip(rows.column("hits").to_pylist(), rows.column("items").to_pylist(), strict=True)
                ):
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        mark[words.first_word[r] + a : words.first_word[r] + b] = True
                    items[r].update(more)
            opens, closes = _runs(mark, words.row)
            home = words.row[opens]
            spans = np.stack([opens - words.first_word[home], closes + 1 - words.first_word[home]], 1).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in kept),
                    pa.array(words.counts, pa.int64()),
                    lists(spans, 2 * np.bincount(home, minlength=n), pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=[*kept, *added],
            )

    schema = StructType([docs.schema[c] for c in kept]).add("n_words", LongType())
    schema = schema.add("hits", ArrayType(LongType())).add("items", ArrayType(StringType()))
    return docs.mapInArrow(find, schema)


def _parts(benchmark: DataFrame) -> DataFrame:
    """(item, part, words): the words of each item, long items in overlapping parts."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(WORDS), 0)
    step = PART_WORDS - WINDOW + 1
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - F.lit(WINDOW), F.lit(0)), F.lit(step))
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    rows = benchmark.select(item, words.alias("all")).where(F.size("all") > 0)
    rows = rows.select("item", "all", F.explode(starts).alias("part"))
    return rows.select("item", "part", F.array_join(F.slice("all", F.col("part") + 1, PART_WORDS), " ").alias("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` (text and others) with ``n_words``, ``hits`` (first word and word after the
    last of each run of words inside a benchmark window, flat) and ``items`` (distinct ids, as
    strings in their order, of the items of which a window occurs).

    The documents are read once, without a shuffle, for every ``pass_bytes`` of the words of
    ``benchmark`` (item_id, text); that many are sent to the tasks at a time, so the size of the
    benchmark is not limited by memory. Several passes are written as tables between them.

    Null and empty texts have no words; an item without words has no window. Items with the
    same id are one item; a null id is the empty string. Equal windows of several items are
    searched for once. Columns of ``docs`` named like the added ones are replaced.
    """
    docs = docs.drop("n_words", "hits", "items")
    parts = durable(_parts(benchmark))
    size = parts.agg(F.sum(F.octet_length("words") + 2)).first()[0] or 0
    n = max(1, -(-size // pass_bytes))
    for block in range(n):
        rows = parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(n)) == block).select("item", "words").toArrow()
        ids = rows.column("item").to_pylist()
        texts = pa.concat_arrays(rows.column("words").chunks) if rows.num_rows else pa.array([], pa.string())
        docs = _search(docs if block == 0 else durable(docs), ids, texts)
    return docs


def n_hit(hits: Column) -> Column:
    """How many words the runs of ``hits`` hold."""
    signed = F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, ws[pos:pos + least(len(ws), {WINDOW}) - 1] AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS pos FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(w) AS size FROM windows),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d),
found AS (
  SELECT p.doc_id, p.pos, s.size, windows.item FROM places p JOIN sizes s ON p.pos + s.size - 1 <= len(p.ws)
  JOIN windows ON windows.w = p.ws[p.pos:p.pos + s.size - 1]),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
  SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id
"""

"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tarn.llm.batches import held, lists, slices, utf8
from tarn.llm.wordtable import WordTable

SPACE = "▁"
#: Bytes from which a word is merged on its own.
LONG_WORD = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a byte-pair model with byte fallback, read through its library."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(self.names))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        ids = [i for i, s in enumerate(special) if not s]
        self.ids = np.array(ids)
        self.texts = [self.names[i].encode() for i in ids]
        # Better scores merge first.
        scores = np.array([sp.get_score(i) for i in ids])
        self.merge_rank = np.unique(-scores, return_inverse=True)[1]
        if any(SPACE in self.names[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece reaches over the beginning of a word")


def packed(data: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Eight bytes from at + 8 * step on as one big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + 8 * step + k]
    return out


def suffix_array(data: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Suffixes of data[:n] sorted by ``depth`` bytes; ``data`` is padded by as many."""
    order = np.arange(n)
    keys = [packed(data, order, step) for step in range(-(-depth // 8))]
    order = np.argsort(keys[0], kind="stable")
    for step in range(1, len(keys)):
        group = np.ones(n, bool)
        for k in keys[:step]:
            group[1:] &= k[order][1:] == k[order][:-1]
        group[0] = False
        tied = group | np.append(group[1:], False)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        number = np.cumsum(~group)[at]
        order[at] = order[at][np.lexsort((keys[step][order[at]], number))]
    return order


def occurrences(data: np.ndarray, n: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece) of every occurrence of every piece, by binary search in a suffix array.

    Each piece narrows a range of the array eight bytes at a time.
    """
    depth = max(map(len, texts))
    order = suffix_array(data, n, depth)
    sizes = np.array([len(t) for t in texts])
    low, high = np.zeros(len(texts), np.int64), np.full(len(texts), n)
    width = -(-depth // 8)
    first = np.frombuffer(b"".join(t.ljust(8 * width, b"\0") for t in texts), ">u8").reshape(-1, width)
    last = np.frombuffer(b"".join(t.ljust(8 * width, b"\xff") for t in texts), ">u8").reshape(-1, width)
    for step in range(width):
        keys = packed(data, order, step)
        use = np.flatnonzero((sizes > 8 * step) & (low < high))
        if not len(use):
            break
        bounds = []
        for key, right in ((first[use, step].astype(np.uint64), False), (last[use, step].astype(np.uint64), True)):
            a, b = low[use].copy(), high[use].copy()
            while (open_ := a < b).any():
                middle = (a + b) // 2
                probe = keys[np.minimum(middle, n - 1)]
                below = open_ & ((probe <= key) if right else (probe < key))
                a = np.where(below, middle + 1, a)
                b = np.where(open_ & ~below, middle, b)
            bounds.append(a)
        low[use], high[use] = bounds
    counts = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[low[piece] + within], piece


def relax(n: int, start: np.ndarray, end: np.ndarray, rank: np.ndarray, word: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Boundaries of the symbols after merging, from boundaries ``cut`` between characters.

    Edges are sorted by position. In each round every word takes its best edge that covers
    exactly two symbols, the leftmost of equals, until none is left: the merges of byte-pair
    encoding, in its order, for all words at once.
    """
    order = np.lexsort((start, word))
    start, end, rank, word = start[order], end[order], rank[order], word[order]
    while len(start):
        inner = np.cumsum(cut)
        open_ = cut[start] & cut[end]
        start, end, rank, word = start[open_], end[open_], rank[open_], word[open_]
        gaps = inner[end - 1] - inner[start]
        alive = gaps > 0
        start, end, rank, word, gaps = start[alive], end[alive], rank[alive], word[alive], gaps[alive]
        ready = np.flatnonzero(gaps == 1)
        if not len(ready):
            break
        owner = word[ready]
        key = rank[ready] * np.int64(1 << 32) + start[ready]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(key, heads)
        chosen = ready[key == np.repeat(best, np.diff(np.append(heads, len(key))))]
        # The one boundary inside each chosen edge goes.
        inside = np.searchsorted(inner, inner[start[chosen]] + 1)
        cut[inside] = False
    return cut


def relax_long(start: np.ndarray, end: np.ndarray, rank: np.ndarray, cut: np.ndarray) -> None:
    """The same for the edges of one long word, with a queue instead of rounds."""
    edges = {(s, e): r for s, e, r in zip(start.tolist(), end.tolist(), rank.tolist(), strict=True)}
    marks = (np.flatnonzero(cut[start.min() : end.max() + 1]) + start.min()).tolist()
    after = dict(zip(marks[:-1], marks[1:], strict=True))
    before = dict(zip(marks[1:], marks[:-1], strict=True))
    queue = [(edges[s, e], s, e) for s, e in zip(marks[:-2], marks[2:], strict=True) if (s, e) in edges]
    heapq.heapify(queue)
    while queue:
        _, s, e = heapq.heappop(queue)
        middle = after.get(s)
        if middle is None or after.get(middle) != e:
            continue
        del after[middle], before[middle]
        cut[middle] = False
        after[s], before[e] = e, s
        for a, b in ((before.get(s), e), (s, after.get(e))):
            if (a, b) in edges:
                heapq.heappush(queue, (edges[a, b], a, b))


class Codec:
    """Encodes words through one suffix array for each batch of words not seen before."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.table = WordTable()

    def _learn(self, words: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new words; the first one of a text has a space of its own before it."""
        p, mark = self.pieces, SPACE.encode()
        raw = [mark * f + w.replace(b" ", mark) for w, f in zip(words, first.tolist(), strict=True)]
        depth = 8 * -(-max(map(len, p.texts)) // 8)
        # A word ends with a byte that no text holds, so no match crosses it.
        joined = b"\xff".join(raw) + b"\xff"
        n = len(joined)
        data = np.frombuffer(joined + b"\xff" * (depth + 8), np.uint8)
        start, piece = occurrences(data, n, p.texts)
        sizes = np.array([len(t) for t in p.texts])
        cut = np.zeros(n + 1, bool)
        cut[:n] = (data[:n] & 0xC0) != 0x80
        ends = np.cumsum([len(r) + 1 for r in raw])
        word = np.searchsorted(ends, start, "right")
        end, rank = start + sizes[piece], p.merge_rank[piece]
        for w in [w for w, r in enumerate(raw) if len(r) > LONG_WORD]:
            own = word == w
            if own.any():
                relax_long(start[own], end[own], rank[own], cut)
        short = np.array([len(r) <= LONG_WORD for r in raw])[word]
        cut = relax(n, start[short], end[short], rank[short], word[short], cut)
        # A symbol is a piece if an occurrence spans it exactly; else it falls back to bytes.
        at = np.flatnonzero(cut[:n])
        follow = np.append(at[1:], n)
        name = np.full(n, -1, np.int64)
        exact = np.full(n, -1, np.int64)
        exact[at] = follow
        match = exact[start] == start + sizes[piece]
        name[start[match]] = p.ids[piece[match]]
        keep = np.flatnonzero(data[:n] != 0xFF)
        symbol = at[np.searchsorted(at, keep, "right") - 1]
        whole = name[symbol] >= 0
        emit = ~whole | (keep == symbol)
        ids = np.where(whole, name[symbol], p.byte_ids[data[keep]])[emit]
        owner = np.searchsorted(ends, keep[emit], "right")
        counts = np.bincount(owner, minlength=len(words))
        return ids, np.cumsum(counts) - counts, counts

    @staticmethod
    def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of the words: each text is cut where a run of spaces begins."""
        space = data == 0x20
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets[:-1]] = True
        # A text's own beginning is one; so are spaces there, which follow the added one.
        opens |= begin[:-1]
        start = np.flatnonzero(opens)
        row = np.searchsorted(offsets, start, "right") - 1
        return start, np.append(start[1:], len(data)), row

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of texts; empty ones have no ids."""
        if (data == 0xE2).any() and SPACE.encode() in (raw := data.tobytes()):
            # To the model this character is a space.
            texts = [raw[a:b].replace(SPACE.encode(), b" ").decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data, offsets = utf8(pa.array(texts, pa.string()))
        start, end, row = self.words(data, offsets)
        first = np.append(True, row[1:] != row[:-1]) if len(row) else np.empty(0, bool)
        ids, sizes = self.table.ids(data, start, end, first, self._learn)
        counts = np.zeros(len(offsets) - 1, np.int64)
        np.add.at(counts, row, sizes)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts; null is empty."""
        return self.encode_bytes(*utf8(pa.array(texts, pa.string())))


class Decoder:
    def __init__(self, pieces: Pieces):
        self.parts = [
            bytes([pieces.byte_of[i]]) if i in pieces.byte_of else x.replace(SPACE, " ").encode()
            for i, x in enumerate(pieces.names)
        ]

        sizes = np.array([len(x) for x in self.parts])
        self.flat = np.frombuffer(b"".join(self.parts), np.uint8)
        self.start, self.size = np.cumsum(sizes) - sizes, sizes

    def same(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether ids[at[i]:at[i + 1]] decode to the i-th text, for all texts at once."""
        sizes = self.size[ids]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[np.repeat(self.start[ids] - stops[:-1], sizes) + np.arange(stops[-1])]
        ends = stops[at]
        good = np.zeros(len(offsets) - 1, bool)
        for i, (a, b, x, y) in enumerate(zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)):
            # The first word's own space is no part of the text.
            good[i] = (a == b and x == y) or (b - a == y - x + 1 and np.array_equal(out[a + 1 : b], data[x:y]))
        return good

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; byte pieces that are no UTF-8 become replacement marks."""
        raw = b"".join(map(self.parts.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def coders(path: str) -> tuple[Codec, Decoder]:
    """The codec and decoder of this Python worker for the model at ``path``."""

    def make() -> tuple[Codec, Decoder]:
        pieces = Pieces(path)
        return Codec(pieces), Decoder(pieces)

    return held("sentencepiece", ("coders", path), make)


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` (text and others) with ``ids``, as the model's library encodes the text.

    Null and empty texts have an empty list. One long text is one row's work. Columns
    of ``docs`` named ids are replaced; no row is shuffled.
    """
    docs = docs.drop("ids")
    path = model or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for rows, data, at in slices(batches):
            codec = codec or coders(path)[0]
            ids, offsets = codec.encode_bytes(data, at)
            column = lists(ids, np.diff(offsets), pa.int32())
            yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, "ids"])

    return docs.mapInArrow(encode, StructType(list(docs.schema.fields)).add("ids", ArrayType(IntegerType())))


def decode_pieces(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` (ids and others) with ``decoded``, the text of the ids; null ids give null."""
    rows = rows.drop("decoded")
    path = model or default_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or coders(path)[1]
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists_ = part.column("ids")
                out = [None if x is None else decoder.decode(x) for x in lists_.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"]
                )

    return rows.mapInArrow(decode, StructType(list(rows.schema.fields)).add("decoded", "string"))


def encoded_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_chars, round_trip) of every document: how many ids, a
    checksum of them as little-endian 32-bit numbers, and whether they decode to the text."""
    path = model or default_path()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for rows, data, at in slices(batches):
            if codec is None:
                codec, decoder = coders(path)
            ids, offsets = codec.encode_bytes(data, at)
            ids = ids.astype("<u4")
            spans = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in spans], pa.int64()),
                    pc.fill_null(pc.utf8_length(rows.column("text")), 0).cast(pa.int64()),
                    pa.array(decoder.same(ids, offsets, data, at)),
                ],
                names=["doc_id", "n_tokens", "ids_crc32", "n_chars", "round_trip"],
            )

    schema = "doc_id long, n_tokens long, ids_crc32 long, n_chars long, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(digest, schema)

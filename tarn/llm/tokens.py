"""Whole texts to token ids, each distinct word encoded once per task."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from tarn.llm.batches import held, utf8
from tarn.llm.wordtable import WordTable

_JOINED = 2_000
#: White space of ASCII, and the first bytes of characters that may be other white space.
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, first in its row) of the texts' pieces, cut where tokens cannot reach
    across: a space between two characters that are not white space always begins a token.
    All but the first piece of a text have lost that space.

    Where the neighbour may be white space outside ASCII nothing is cut, which is always right.
    """
    at = np.flatnonzero(data == 0x20)
    row = np.searchsorted(offsets, at, "right") - 1
    inside = (at > offsets[row]) & (at + 1 < offsets[row + 1])
    at, row = at[inside], row[inside]
    before, after = data[at - 1], data[at + 1]
    wide = (before >= 0x80) & ((data[np.maximum(at - 2, 0)] == 0xC2) | _WIDE[data[np.maximum(at - 3, 0)]])
    good = ~(_SPACES[before] | _SPACES[after] | _WIDE[after] | wide)
    at, row = at[good], row[good]
    whole = np.flatnonzero(np.diff(offsets))
    start, end = np.concatenate([offsets[whole], at + 1]), np.concatenate([offsets[whole + 1], at])
    first = np.concatenate([np.ones(len(whole), bool), np.zeros(len(at), bool)])
    row = np.concatenate([whole, row])
    order = np.argsort(start, kind="stable")
    return start[order], np.sort(end), row[order], first[order]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for the file at ``path``."""
    return held("tokenizers", ("encoder", path), lambda: Encoder(path))


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, as its ``encode`` gives.

    The library's own cache is small, and most of a corpus is the same words: words are
    looked up in a table, and those it lacks are encoded together.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.id_type = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        names = (self.tokenizer.id_to_token(i) or "" for i in range(size))
        self.opens = np.array([x.startswith("Ġ") for x in names])
        self.table = WordTable()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new pieces; plain ones are encoded as one text, in which each opens a token."""
        texts = [w.decode() if f else " " + w.decode() for w, f in zip(words, first.tolist(), strict=True)]
        plain = [k for k, t in enumerate(texts) if t[0] == " " and len(t) > 1 and " " not in t[1:] and not t[-1].isspace()]
        single = sorted(set(range(len(texts))).difference(plain))
        groups = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        parts, sizes, keys = [], [], []
        for group, ids in zip(groups, self._encode(["".join([texts[k] for k in g]) for g in groups]), strict=True):
            flat = np.array(ids, np.uint32)
            opens = np.flatnonzero(self.opens[flat])
            if len(opens) != len(group) or opens[0] != 0:
                single += group
                continue
            keys += group
            parts.append(flat)
            sizes.append(np.diff(np.append(opens, len(flat))))
        for k, ids in zip(single, self._encode([texts[k] for k in single]), strict=True):
            keys.append(k)
            parts.append(np.array(ids, np.uint32))
            sizes.append(np.array([len(ids)]))
        added = np.concatenate(sizes)
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[keys], size[keys] = np.cumsum(added) - added, added
        return np.concatenate(parts), begin, size

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets): every text's ids with id 0 after them."""
        start, end, row, first = piece_bounds(data, offsets)
        ids, sizes = self.table.ids(data, start, end, first, self._learn)
        n = len(offsets) - 1
        counts = np.zeros(n, np.int64)
        np.add.at(counts, row, sizes)
        stops = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.zeros(stops[-1], np.uint32)
        keep = np.ones(stops[-1], bool)
        keep[stops[1:] - 1] = False
        out[keep] = ids
        return out, stops

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts; null is empty."""
        return self.encode_bytes(*utf8(pa.array(texts, pa.string())))

"""Ids of distinct words, found by hash: what the token coders remember."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tarn.llm.batches import prefix_hash, substring_hash

#: Words and ids that a worker remembers; the words of a slice beyond that are forgotten after it.
WORDS = 1_000_000
IDS = 8_000_000
#: Words that are gathered before they are merged into the sorted ones.
RECENT = 1 << 17
_FIRST = np.uint64(0xA0761D6478BD642F)


class WordTable:
    """Words go by a 64-bit hash of their bytes (two of a million words share one in some
    thirty million workers); for each the table holds its ids, in some 40 bytes."""

    def __init__(self):
        none = np.empty(0, np.int64)
        self.shelves = [(np.empty(0, np.uint64), none), (np.empty(0, np.uint64), none)]
        self.flat, self.start, self.size = np.empty(0, np.uint32), none, none

    def find(self, names: np.ndarray) -> np.ndarray:
        """Which entry each name has, -1 for none."""
        out = np.full(len(names), -1, np.int64)
        for known, entry in self.shelves:
            if len(known):
                at = np.minimum(np.searchsorted(known, names), len(known) - 1)
                out = np.where(known[at] == names, entry[at], out)
        return out

    def _put(self, shelf: int, names: np.ndarray, entry: np.ndarray) -> None:
        known, old = self.shelves[shelf]
        known, old = np.concatenate([known, names]), np.concatenate([old, entry])
        order = np.argsort(known, kind="stable")
        self.shelves[shelf] = known[order], old[order]

    def remember(self, names: np.ndarray, entry: np.ndarray) -> None:
        self._put(1, names, entry)
        if len(self.shelves[1][0]) > RECENT:
            self._put(0, *self.shelves[1])
            self.shelves[1] = np.empty(0, np.uint64), np.empty(0, np.int64)

    def ids(
        self,
        data: np.ndarray,
        start: np.ndarray,
        end: np.ndarray,
        first: np.ndarray,
        learn: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    ) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, how many for each) of the words data[start:end]; ``first`` marks those at
        the start of a text, which are other words than the same bytes elsewhere.

        ``learn`` gives the ids of distinct words not seen before: flat ids, and where those
        of each word start and how many they are.
        """
        names = substring_hash(prefix_hash(data), start, end) ^ np.where(first, _FIRST, np.uint64(0))
        names, index, inverse = np.unique(names, return_index=True, return_inverse=True)
        entry = self.find(names)
        new = np.flatnonzero(entry < 0)
        known, held = len(self.size), len(self.flat)
        if len(new):
            at = index[new]
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            flat, begin, size = learn(words, first[at])
            entry[new] = known + np.arange(len(new))
            self.start = np.concatenate([self.start, held + begin])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        at = entry[inverse]
        sizes = self.size[at]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        out = self.flat[np.repeat(self.start[at] - (stops - sizes), sizes) + np.arange(total)]
        if len(new):
            if len(self.size) > WORDS or len(self.flat) > IDS:
                self.flat, self.start, self.size = self.flat[:held], self.start[:known], self.size[:known]
            else:
                self.remember(names[new], entry[new])
        return out, sizes

"""Suffix arrays by prefix doubling, on flat numpy arrays."""

from __future__ import annotations

import numpy as np


def suffix_ranks(keys: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes of each row by their first 1, 2, 4, ... symbols.

    Suffixes are ordered by row, then by symbol keys; they end with their row. The ranks of
    the last level are all different. A rank is the place of the first suffix of its group,
    so only groups of more than one are sorted again.
    """
    n = len(keys)
    _, symbol = np.unique(keys, return_inverse=True)
    first = row.astype(np.int64) * (int(symbol.max(initial=0)) + 1) + symbol
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_keys = first[order]
    new = np.ones(n, bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels = [rank.astype(np.int32)]
    single = new & np.append(new[1:], True)
    active = order[~single]
    width = 1
    while len(active):
        ahead = active + width
        inside = ahead < n
        follow = np.full(len(active), -1, np.int64)
        follow[inside] = np.where(row[ahead[inside]] == row[active[inside]], rank[ahead[inside]], -1)
        both = rank[active] * (n + 1) + follow + 1
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        group = both // (n + 1)
        opens = np.ones(len(active), bool)
        opens[1:] = group[1:] != group[:-1]
        new = np.ones(len(active), bool)
        new[1:] = both[1:] != both[:-1]
        at = np.arange(len(active))
        start = at[new][np.cumsum(new) - 1]
        rank = rank.copy()
        rank[active] = group + start - at[opens][np.cumsum(opens) - 1]
        levels.append(rank.astype(np.int32))
        active = active[~(new & np.append(new[1:], True))]
        width *= 2
    return levels


def longest_matches(levels: list[np.ndarray], row: np.ndarray) -> np.ndarray:
    """For each suffix the longest prefix it shares with another suffix of its row.

    The longest common prefixes of neighbours in the suffix array, read off the levels from
    the widest down.
    """
    n = len(row)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    home = row[order[:-1]]
    same = home == row[order[1:]]
    length = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        live = same & (a < n) & (b < n)
        at = np.flatnonzero(live)
        at = at[(row[a[at]] == home[at]) & (row[b[at]] == home[at])]
        at = at[levels[k][a[at]] == levels[k][b[at]]]
        length[at] += 1 << k
        a[at] += 1 << k
        b[at] += 1 << k
    out = np.zeros(n, np.int64)
    out[order[:-1]] = length
    out[order[1:]] = np.maximum(out[order[1:]], length)
    return out

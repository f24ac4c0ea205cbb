"""A logarithmic family of suffix arrays over byte strings (numpy).

Texts arrive in batches. A new batch gets a suffix array of its own (:func:`suffix_order`, rank
doubling up to the match length), is scanned against every level that exists, and then becomes a
level; two levels made of equally many batches merge into one, so there are never more levels than
the logarithm of the number of batches, and each suffix is merged that often at most. Only suffixes
that start a match of the asked length count, and a level keeps one of each distinct.
"""
from __future__ import annotations

import numpy as np

from .hashing import U


def _ranks(a: np.ndarray, b: np.ndarray, width_b: int) -> np.ndarray:
    """Dense ranks of the pairs (a, b), b < 2**width_b."""
    n = len(a)
    key = (a.astype(np.uint64) << U(width_b)) | b.astype(np.uint64)
    place = max(1, (n - 1).bit_length())
    top = int(key.max()).bit_length() if n else 0
    out = np.empty(n, np.int64)
    if top + place <= 64:  # sort pair and place as one number
        both = np.sort((key << U(place)) | np.arange(n, dtype=np.uint64))
        order = (both & U((1 << place) - 1)).astype(np.int64)
        key = both >> U(place)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    out[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if n else 0
    return out


def suffix_order(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Dense lexicographic ranks of the suffixes at ``at`` by their first ``length`` bytes (4 or more).

    Every suffix asked for has that many bytes. Ranks by 4, 8, 16 ... bytes are joined in pairs; each
    round ranks only the places that a later one looks at.
    """
    if length < 4:
        raise ValueError("matches have four bytes or more")
    if not len(at):
        return np.zeros(0, np.int64)
    sizes = [4]
    while sizes[-1] * 2 < length:
        sizes.append(sizes[-1] * 2)
    if sizes[-1] != length:
        sizes.append(length)
    needed = [at]
    for big, small in zip(sizes[:0:-1], sizes[-2::-1]):
        mark = np.zeros(len(text), bool)
        mark[needed[0]] = True
        mark[needed[0] + (big - small)] = True
        needed.insert(0, np.flatnonzero(mark))
    p = needed[0]
    b = [text[p + i].astype(np.uint64) for i in range(4)]
    rank = np.empty(len(text), np.int64)
    got = _ranks((b[0] << U(8)) | b[1], (b[2] << U(8)) | b[3], 16)
    rank[p] = got
    for small, big, p in zip(sizes, sizes[1:], needed[1:]):
        got = _ranks(rank[p], rank[p + (big - small)], max(1, int(got.max()).bit_length()))
        fresh = np.empty(len(text), np.int64)
        fresh[p] = got
        rank = fresh
    return got


class SuffixFamily:
    """Levels of sorted, distinct strings of ``length`` bytes, and how many batches each holds."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[int, np.ndarray]] = []

    def add(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes in a batch. Returns, for each suffix, the first place in the batch (an index into
        ``at``) with the same match, and whether an earlier batch has it."""
        rank = suffix_order(text, at, self.length)
        if not len(rank):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        first = np.full(int(rank.max()) + 1, len(at), np.int64)
        np.minimum.at(first, rank, np.arange(len(at)))
        windows = np.lib.stride_tricks.sliding_window_view(text, self.length)
        keys = np.ascontiguousarray(windows[at[first]]).view(f"S{self.length}").ravel()
        known = np.zeros(len(keys), bool)
        for _, level in self.levels:
            found = np.searchsorted(level, keys)
            known |= level[np.minimum(found, len(level) - 1)] == keys
        self._push(keys[~known])
        return first[rank], known[rank]

    def _push(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        batches = 1
        while self.levels and self.levels[-1][0] <= batches:
            n, older = self.levels.pop()
            batches += n
            keys = np.sort(np.concatenate([older, keys]), kind="stable")  # two ascending runs: one merge
        self.levels.append((batches, keys))

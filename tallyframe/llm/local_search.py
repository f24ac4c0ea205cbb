"""Bin packing within one group: best fit decreasing, then swaps that raise the squared fill (numpy).

Moving tokens from an emptier bin to a fuller one raises the sum of squared fills, so the search cannot
go round in circles. The emptiest bin that was not tried yet is the donor: while it can, it makes the exchange
that frees most of it, among moves, one for one, two for one and one for two. When a bin has become empty, all
bins are tried again; the search ends when the bins are as few as a lower bound, or when every bin that is not
full has been tried since one became empty.

Exchanges are looked up by size. Of items of one size in a bin one stands for all, so a bin has at most as many
choices as sizes. For every size t that some bin can give back, the room of the roomiest such bin is known; the
running maximum of t + room tells for a gift of any size the smallest t that makes it fit.
"""
from __future__ import annotations

import numpy as np

NONE = -1


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, in the order given; a size goes where it leaves the least room."""
    free_bins: dict[int, list[int]] = {}
    rooms, n = 0, 0  # rooms: bit r is set if a bin has exactly r places left
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free_bins[room].pop()
            if not free_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        room -= s
        out[i] = b
        if room:
            free_bins.setdefault(room, []).append(b)
            rooms |= 1 << room
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that are needed at least: items over half the capacity lie apart, and what is not small beside the
    small ones left out has no place in the room that these leave (Martello and Toth's bound, for every limit
    of small)."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    of = np.arange(capacity + 1)
    n_from = np.append(np.cumsum(count[::-1])[::-1], 0)          # items of a size or more
    sum_from = np.append(np.cumsum((count * of)[::-1])[::-1], 0)
    half = capacity // 2 + 1
    limits = np.arange(0, half)
    large = n_from[capacity - limits + 1]                        # no item from the limit up fits beside them
    middle = n_from[half] - large
    middle_sum = sum_from[half] - sum_from[capacity - limits + 1]
    small_sum = sum_from[limits] - sum_from[half]
    more = np.maximum(0, -(-(small_sum - (middle * capacity - middle_sum)) // capacity))
    return int((large + middle + more).max())


def choices(items: list[int], size: list[int]) -> np.ndarray:
    """Rows (total size, item, other item or none): one for each total of one item, and of two."""
    of: dict[int, list[int]] = {}
    for i in items:
        of.setdefault(size[i], []).append(i)
    kinds = np.array(sorted(of), np.int64)
    first = np.array([of[s][0] for s in kinds.tolist()], np.int64)
    ones = np.stack([kinds, first, np.full(len(kinds), NONE)], axis=1)
    a, b = np.triu_indices(len(kinds), 1)
    twins = [(2 * s, v[0], v[1]) for s, v in of.items() if len(v) > 1]
    twos = np.concatenate([np.stack([kinds[a] + kinds[b], first[a], first[b]], axis=1), np.array(twins, np.int64).reshape(-1, 3)])
    return np.concatenate([ones, twos[np.unique(twos[:, 0], return_index=True)[1]]])


class _Search:
    def __init__(self, bins: np.ndarray, sizes: np.ndarray, capacity: int):
        self.size, self.capacity = sizes.tolist(), capacity
        self.content: dict[int, list[int]] = {}
        for i, b in enumerate(bins.tolist()):
            self.content.setdefault(b, []).append(i)
        self.fill = np.bincount(bins, weights=sizes).astype(np.int64)
        self.known: dict[int, np.ndarray] = {}

    def options(self, b: int) -> np.ndarray:
        if b not in self.known:
            self.known[b] = choices(self.content[b], self.size)
        return self.known[b]

    def drain(self, donor: int) -> None:
        """Exchanges with bins that are as full or fuller, until the donor is empty or none frees more of it."""
        others = np.flatnonzero((self.fill < self.capacity) & (self.fill > 0))
        others = others[others != donor]
        if not len(others):
            return
        rows = [self.options(b) for b in others.tolist()]
        table = np.concatenate(rows)
        at = np.repeat(others, [len(r) for r in rows])
        while self.content[donor]:
            fuller = others[self.fill[others] >= self.fill[donor]]
            if not len(fuller):
                return
            eligible, room = self.fill[at] >= self.fill[donor], self.capacity - self.fill[at]
            gifts = self.options(donor)
            found = None
            for single in (True, False):  # two for two is not looked at
                mine = gifts[(gifts[:, 2] == NONE) == single]
                usable = eligible if single else eligible & (table[:, 2] == NONE)
                reach = np.full(self.capacity + 1, NONE, np.int64)
                np.maximum.at(reach, table[usable, 0], room[usable] + table[usable, 0])
                reach[0] = (self.capacity - self.fill[fuller]).max()
                back = np.searchsorted(np.maximum.accumulate(reach), mine[:, 0])
                gain = np.where(back < mine[:, 0], mine[:, 0] - back, 0)
                if len(gain) and gain.max() > (found[0] if found else 0):
                    k = int(gain.argmax())
                    found = (int(gain[k]), mine[k], int(back[k]), usable)
            if found is None:
                return
            gain, gift, back, usable = found
            if back:
                fits = np.flatnonzero(usable & (table[:, 0] == back) & (room >= gain))
                k = fits[room[fits].argmin()]
                to, returned = int(at[k]), table[k, 1:]
            else:
                fits = fuller[self.capacity - self.fill[fuller] >= gain]
                to, returned = int(fits[self.fill[fits].argmax()]), ()
            given, returned = {int(i) for i in gift[1:] if i >= 0}, {int(i) for i in returned if i >= 0}
            self.content[donor] = [i for i in self.content[donor] if i not in given] + sorted(returned)
            self.content[to] = [i for i in self.content[to] if i not in returned] + sorted(given)
            self.fill[donor] -= gain
            self.fill[to] += gain
            self.known.pop(donor, None)
            self.known.pop(to, None)
            rest = at != to
            table, at = table[rest], at[rest]
            if self.fill[to] < self.capacity:
                fresh = self.options(to)
                table, at = np.concatenate([table, fresh]), np.concatenate([at, np.full(len(fresh), to)])
            else:
                others = others[others != to]
                if not len(others):
                    return


def improve(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Empties bins by exchanges while there are more than the lower bound."""
    search = _Search(bins, sizes, capacity)
    least = lower_bound(sizes, capacity)
    n = len(search.content)
    tried = np.zeros(len(search.fill), bool)
    while n > least:
        left = np.flatnonzero(~tried & (search.fill < capacity) & (search.fill > 0))
        if not len(left):
            break
        donor = int(left[search.fill[left].argmin()])
        search.drain(donor)
        if search.content[donor]:
            tried[donor] = True
        else:
            n -= 1
            tried[:] = False
    for b, items in search.content.items():
        bins[items] = b
    return np.unique(bins, return_inverse=True)[1]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, numbered from 0 without gaps. ``sizes`` come largest first."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    bins = best_fit(sizes, capacity)
    return improve(bins, sizes, capacity)


def worth_merging(fill: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """Which bins should meet those of other groups: the emptiest, ``most`` of them, and no more than have the room of
    one whole bin together (what is beyond that the group could not save by itself)."""
    room = capacity - fill
    order = np.argsort(-room, kind="stable")[:most]
    before = np.cumsum(room[order]) - room[order]
    out = np.zeros(len(fill), bool)
    out[order] = (before < capacity) & (room[order] > 0)
    return out

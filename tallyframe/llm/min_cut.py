"""Minimum cut between two terminals by Dinic's maximum flow, for graphs with integer capacities."""
from __future__ import annotations


class Network:
    """Nodes 0 .. n-1 between a source and a sink. Undirected edges take their capacity in both directions."""

    def __init__(self, n: int):
        self.source, self.sink = n, n + 1
        self.edges_of: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.room: list[int] = []

    def _add(self, a: int, b: int, there: int, back: int) -> None:
        self.edges_of[a].append(len(self.to))
        self.edges_of[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.room += (there, back)

    def tie(self, node: int, gain: int) -> None:
        """A positive gain binds the node to the source, a negative one to the sink."""
        if gain > 0:
            self._add(self.source, node, gain, 0)
        elif gain < 0:
            self._add(node, self.sink, -gain, 0)

    def join(self, a: int, b: int, capacity: int) -> None:
        if capacity > 0:
            self._add(a, b, capacity, capacity)

    def _levels(self) -> list[int]:
        level = [-1] * len(self.edges_of)
        level[self.source] = 0
        line = [self.source]
        for a in line:
            for e in self.edges_of[a]:
                b = self.to[e]
                if self.room[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    line.append(b)
        return level

    def flow(self) -> int:
        """The greatest flow; afterwards ``room`` holds what is left of the capacities."""
        total, to, room, edges_of, sink = 0, self.to, self.room, self.edges_of, self.sink
        while (level := self._levels())[sink] >= 0:
            turn = [0] * len(edges_of)
            path: list[int] = []
            node = self.source
            while True:
                if node == sink:
                    least = min(room[e] for e in path)
                    total += least
                    cut = len(path)
                    for i, e in enumerate(path):
                        room[e] -= least
                        room[e ^ 1] += least
                        if not room[e] and i < cut:
                            cut = i
                    node = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = edges_of[node]
                while turn[node] < len(edges):
                    e = edges[turn[node]]
                    if room[e] and level[to[e]] == level[node] + 1:
                        break
                    turn[node] += 1
                if turn[node] < len(edges):
                    path.append(e)
                    node = to[e]
                elif path:
                    node = to[path.pop() ^ 1]
                    turn[node] += 1
                else:
                    break
        return total

    def source_side(self) -> list[bool]:
        """For every node whether it lies with the source, after ``flow``. Of several least cuts, the one with
        the most nodes on that side: a node goes to the sink only if room is left on a way there."""
        reach = [False] * len(self.edges_of)
        reach[self.sink] = True
        line = [self.sink]
        for b in line:
            for e in self.edges_of[b]:
                a = self.to[e]
                if self.room[e ^ 1] and not reach[a]:
                    reach[a] = True
                    line.append(a)
        return [not r for r in reach[:-2]]

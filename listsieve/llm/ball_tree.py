"""A ball tree over sparse vectors, for the greatest inner products.

A node is a centroid and a radius around all its vectors, so no inner product of a query q with
a vector below it is above q . centroid + |q| * radius, where the terms of q that the node lacks
count as zero. A search opens nodes by that bound,
greatest first, and ends when it falls below what the search has found. Bounds are computed in
doubles and raised by far more than their rounding errors; scores at the leaves are integers.
"""

from __future__ import annotations

import heapq
from bisect import insort
from dataclasses import dataclass

import numpy as np

LEAF = 32
#: Share of the lengths involved by which bounds are raised; doubles err by some 1e-12 at most.
SLACK = 1e-9

#: (score with its sign turned, 0 for a null id, id): ascending is best first.
Found = tuple[int, int, int]


@dataclass
class Queries:
    """Sparse queries: ``bounds[i]..bounds[i+1]`` are the terms and whole weights of query i. None
    is empty."""

    bounds: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Node:
    """``bound``: for each query, no score below the node is greater. A leaf has its rows' entries."""

    bound: np.ndarray
    children: tuple[Node, ...]
    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    keys: list[tuple[int, int]]


class Tree:
    """Vectors of whole values: row i has the terms ``terms[starts[i]:starts[i+1]]``. No row is
    empty. ``scale``: each term's factor, above 0, by which the geometry measures it (queries are
    measured by weight / scale, so that inner products stay as they are)."""

    def __init__(self, starts, terms, values, keys, scale: np.ndarray, queries: Queries):
        self.scale, self.queries = scale, queries
        self.query_x = queries.weights / scale[queries.terms]
        self.opened = 0
        self.root = self._build(starts, terms, values, keys)

    def _build(self, starts, terms, values, keys) -> Node:
        n, size = len(keys), len(self.scale)
        x = values * self.scale[terms]
        squares = np.add.reduceat(x * x, starts[:-1])
        center = np.bincount(terms, x, size) / n
        norm = float(np.sqrt(center @ center))

        def far(y: np.ndarray, square: float) -> np.ndarray:
            """Squared distances to y, raised by more than they may err."""
            found = squares - 2 * np.add.reduceat(x * y[terms], starts[:-1]) + square
            return np.maximum(found, 0) + SLACK * (squares + square)

        away = far(center, norm * norm)
        radius = float(np.sqrt(away.max()))
        # a query's terms that no row here has do not matter, so its length is taken over the others
        there = center[self.queries.terms]
        near = np.add.reduceat(self.query_x * there, self.queries.bounds[:-1])
        length = np.sqrt(np.add.reduceat(self.query_x**2 * (there > 0), self.queries.bounds[:-1]))
        bound = near + length * (radius + SLACK * (norm + radius))
        bound += (bound > 0) * 1.0
        if n <= LEAF:
            return Node(bound, (), starts, terms, values, keys)

        def one(i: int) -> np.ndarray:
            own = slice(starts[i], starts[i + 1])
            return far(np.bincount(terms[own], x[own], size), squares[i])

        a = one(int(away.argmax()))  # the row farthest from the centroid, then the one farthest from that
        side = a - one(int(a.argmax()))
        order = np.argsort(side, kind="stable")
        halves = (np.sort(order[: n // 2]), np.sort(order[n // 2 :]))
        return Node(bound, tuple(self._build(*self._rows(starts, terms, values, keys, h)) for h in halves), *[starts[:1]] * 3, [])

    @staticmethod
    def _rows(starts, terms, values, keys, rows):
        sizes = starts[rows + 1] - starts[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1])
        return np.append(0, ends), terms[at], values[at], [keys[i] for i in rows.tolist()]

    def search(self, query: int, weights: np.ndarray, best: list[Found], k: int) -> None:
        """Put the rows of the greatest scores above 0 into ``best``, ascending and at most k;
        ``weights`` has the query's whole weights by term. Equal scores go by key."""

        def least() -> int:
            return -best[-1][0] if len(best) == k else 1

        heap = [(-self.root.bound[query], 0, self.root)]
        ties = 0
        while heap:
            bound, _, node = heapq.heappop(heap)
            if -bound < least():
                return
            if node.children:
                for child in node.children:
                    if child.bound[query] >= least():
                        ties += 1
                        heapq.heappush(heap, (-child.bound[query], ties, child))
                continue
            self.opened += 1
            scores = np.add.reduceat(node.values * weights[node.terms], node.starts[:-1])
            for i in np.flatnonzero(scores >= least()).tolist():
                entry = (-int(scores[i]), *node.keys[i])
                if len(best) < k or entry < best[-1]:
                    insort(best, entry)
                    del best[k:]

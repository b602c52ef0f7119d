"""A tree over count vectors: points with coordinates, boxes by their greatest corner.

The overlap of two sets whose elements are hashed into groups is at most the sum, over the
groups, of the lesser count. For two boxes the greatest corners bound it for all pairs inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LEAF = 32


def may_link(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether an overlap can reach 75 % of the union of sets with these summed sizes."""
    return 7 * overlap >= 3 * sizes


@dataclass
class Node:
    """``rows``: the points below; ``top``: greatest corner; ``least`` and ``most``: sizes;
    ``label``: the points' common label, or -1."""

    rows: np.ndarray
    top: np.ndarray
    least: int
    most: int
    label: int
    children: tuple[Node, ...]


def build(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Packed from above: halves along the coordinate (or size) that spreads most."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    top, low = own.max(axis=0), own.min(axis=0)
    n = sizes[rows]
    common = int(labels[rows[0]]) if (labels[rows] == labels[rows[0]]).all() else -1
    children: tuple[Node, ...] = ()
    if len(rows) > LEAF:
        spread = top - low
        by = n if n.max() - n.min() >= 2 * spread.max() else own[:, int(spread.argmax())]
        order = rows[np.argsort(by, kind="stable")]
        half = len(order) // 2
        children = (build(points, sizes, labels, order[:half]), build(points, sizes, labels, order[half:]))
    return Node(rows, top, int(n.min()), int(n.max()), common, children)


def pairs(
    points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, right: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of points with different labels whose bounds allow a link, leaf by leaf. Where
    some points are ``right``, only pairs of those with the others."""
    if right is None or not right.any():
        root = build(points, sizes, labels)
        stack = [(root, root)]
    elif right.all():
        return
    else:
        stack = [tuple(build(points, sizes, labels, np.flatnonzero(side)) for side in (~right, right))]
    while stack:
        a, b = stack.pop()
        if a.label == b.label != -1 or 4 * a.most < 3 * b.least or 4 * b.most < 3 * a.least:
            continue
        if not may_link(np.minimum(a.top, b.top).sum(), a.least + b.least):
            continue
        if a is b and a.children:
            x, y = a.children
            stack += [(x, x), (x, y), (y, y)]
        elif a.children and (not b.children or len(a.rows) >= len(b.rows)):
            stack += [(child, b) for child in a.children]
        elif b.children:
            stack += [(a, child) for child in b.children]
        else:
            overlap = np.minimum(points[a.rows][:, None, :], points[b.rows][None, :, :]).sum(axis=2)
            fits = may_link(overlap, sizes[a.rows][:, None] + sizes[b.rows][None, :])
            fits &= labels[a.rows][:, None] != labels[b.rows][None, :]
            if a is b:
                fits = np.triu(fits, 1)
            x, y = np.nonzero(fits)
            if len(x):
                yield a.rows[x], b.rows[y]

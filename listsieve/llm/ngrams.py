"""Hashed character n-grams of whole batches of texts, as arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from listsieve.llm.words import mix

_SEPARATOR = 0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(texts: Sequence[str], letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each between two separators of its own, and each
    one's text. With ``letters_only`` every other character counts as a separator."""
    lowered = [t.lower() for t in texts]
    joined = "".join(f"\0{t}\0" for t in lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    if letters_only:
        points = np.where(letters()[points], points, _SEPARATOR).astype(np.uint32)
    return points, owner


def hashed(points: np.ndarray, owner: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram that lies within one text."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.full(n, order, np.uint64)
    for j in range(order):
        total = total * np.uint64(0x100000001B3) + points[j : j + n]
    inside = owner[:n] == owner[order - 1 :]
    return (mix(total[inside]) & np.uint64(buckets - 1)).astype(np.int64), owner[:n][inside]


def pieces(texts: Sequence[str], limit: int = 1 << 17):
    """Ranges of texts of at most ``limit`` characters together, or one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)

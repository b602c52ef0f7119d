"""Words of whole batches of texts at once, as arrays.

Texts are joined to one byte array, word bounds come from a table of word bytes, and
every word gets a 64-bit hash out of one running sum, so no Python code runs per word.
Hashes depend on the bytes alone and are alike on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes that are hashed together; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _byte_table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


def _is_alnum(b: int) -> bool:
    return b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A


#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: ``[^\x20\x09-\x0D]+`` after lower-casing.
NON_SPACE = _byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = _byte_table(_is_alnum)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64."""
    table = _powers.get(base)
    if table is None or len(table) < size:
        steps = np.full(max(size, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if size <= CHUNK_BYTES + 1:
            _powers[base] = table
    return table[:size]


@dataclass
class Words:
    """The words of some texts, in order.

    ``text``: index of each word's text; ``starts`` and ``ends``: its bytes in ``data``;
    ``hashes``: 64 bits a word; ``bounds``: text i has the words bounds[i]..bounds[i+1].
    """

    data: bytes
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word runs inside a text, and the index of each one's first word."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * _STEP + self.hashes[j : j + n]
        whole = self.text[:n] == self.text[k - 1 : k - 1 + n]
        return mix(total[whole]), np.flatnonzero(whole)


def run_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one run of words; equals the shingle hash of a run of that length."""
    total = np.zeros(1, np.uint64)
    for h in hashes:
        total = total * _STEP + h
    return mix(total)[0]


def split_words(texts: Sequence[str | None], word_bytes: np.ndarray) -> Words:
    """All words of the texts, A-Z lower-cased; a null text has none."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(blobs).translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = word_bytes[raw]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    text_ends = np.cumsum([len(b) + 1 for b in blobs])
    text = np.searchsorted(text_ends, starts, side="right")
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(raw)), out=running[1:])
    hashes = (running[ends] - running[starts]) * _power_table(_INVERSE, len(raw) + 1)[starts]
    bounds = np.searchsorted(text, np.arange(len(blobs) + 1))
    return Words(data, text, starts, ends, mix(hashes + (ends - starts).astype(np.uint64)), bounds)


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` characters together, or one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)

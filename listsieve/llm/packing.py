"""Packing of documents into windows of token ids: best fit, longest first.

Overlong documents are cut into full windows first. What is left goes, longest first, into
the open window with the least room that suffices, found by a segment tree over the rooms.
Then the emptiest windows are dealt out into the gaps of the fullest, so that at most one
window a group is not full; that one is cut into powers of two, which need no padding.

Each task packs the documents of its own input split, in groups of bounded size: nothing is
shuffled, and a lost task gives the same windows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.llm import tokens

WINDOW = 2048
#: Ids of a group of documents that are packed together; a longer document makes its own group.
GROUP_IDS = 4 << 20
#: Sequence ids are ``task << TASK_SHIFT`` and a number in the task.
TASK_SHIFT = 33

#: A part of a document: index in the group, first id, number of ids.
Piece = tuple[int, int, int]


class Rooms:
    """Open windows by room, with a segment tree that tells which rooms occur."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += n
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``need``."""
        node = need + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[Piece]]:
    """Windows of pieces; every id of every document is in one piece. Empty documents have none."""
    windows: list[list[Piece]] = []
    rests: list[Piece] = []
    for i, length in enumerate(lengths):
        full = length - length % window
        windows += [[(i, at, window)] for at in range(0, full, window)]
        if length > full:
            rests.append((i, full, length - full))
    rooms = Rooms(window)
    opened: list[list[Piece]] = []
    for piece in sorted(rests, key=lambda p: (-p[2], p[0])):
        room, w = rooms.tightest(piece[2]) or (window, len(opened))
        if w == len(opened):
            opened.append([])
        opened[w].append(piece)
        if room > piece[2]:
            rooms.put(room - piece[2], w)
    return windows + opened


def fill_gaps(windows: list[list[Piece]], window: int = WINDOW) -> list[list[Piece]]:
    """Deal the emptiest windows out into the gaps of the fullest: one window at most stays
    short, and it is cut into powers of two."""
    sized = sorted(((sum(p[2] for p in w), i) for i, w in enumerate(windows)), key=lambda s: (-s[0], s[1]))
    order = [windows[i] for _, i in sized]
    gaps = [window - s for s, _ in sized]
    last, pool = len(order), []
    at = 0
    while at < last:
        while gaps[at]:
            if not pool:
                if last - 1 <= at:
                    break
                last -= 1
                pool = order.pop()[::-1]
            doc, start, length = pool.pop()
            taken = min(length, gaps[at])
            order[at].append((doc, start, taken))
            gaps[at] -= taken
            if length > taken:
                pool.append((doc, start + taken, length - taken))
        at += 1
    short = pool[::-1] or (order.pop() if order and gaps[len(order) - 1] else [])
    return order + powers_of_two(short)


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in windows whose sizes are the powers of two of their sum."""
    total = sum(p[2] for p in pieces)
    rest, out = pieces[::-1], []
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out.append([])
        while size:
            doc, start, length = rest.pop()
            taken = min(length, size)
            out[-1].append((doc, start, taken))
            size -= taken
            if length > taken:
                rest.append((doc, start + taken, length - taken))
    return out


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
ARROW_PIECES = pa.schema([(name.split()[0], pa.int64()) for name in PIECES.split(", ")])


def pack(
    docs: DataFrame, path: Callable[[], str], blank_led: bool, end_id: int, window: int = WINDOW
) -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text), each in its sequence.

    A document's ids are those of its text (null: none) and ``end_id``, so every row, be it
    repeated or empty, has a piece. Sequences hold at most ``window`` ids; one is either full
    or a power of two. No rows give no pieces; other columns are not read.
    """
    end = np.array([end_id], tokens.ID).tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path(), blank_led)
        sequence = TaskContext.get().partitionId() << TASK_SHIFT
        keys: list[int | None] = []
        ids: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            lengths = [len(x) // 4 for x in ids]
            rows = []
            for pieces in fill_gaps(best_fit(lengths, window), window):
                offset = 0
                for doc, start, length in pieces:
                    crc = zlib.crc32(memoryview(ids[doc])[4 * start : 4 * (start + length)])
                    rows.append((keys[doc], start, length, crc, lengths[doc], sequence, offset))
                    offset += length
                sequence += 1
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW_PIECES)

        for batch in batches:
            doc_ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in tokens.chunks(texts, tokens.CHUNK_CHARS):
                for key, found in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    keys.append(key)
                    ids.append(found + end)
                    total += len(found) // 4 + 1
                    if total >= GROUP_IDS:
                        yield flush()
                        keys, ids, total = [], [], 0
        if keys:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(task, PIECES)

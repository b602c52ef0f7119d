"""Packing of whole documents by patterns of lengths, fitted by non-negative least squares.

A piece is a document, or a window's worth of an overlong one; how pieces go together depends on
their lengths alone. So the histogram of all lengths (one count for each length up to the window)
is planned as a whole: patterns of few lengths that fill a window exactly are enumerated, their
repeat counts fitted to the histogram, rounded, and what they leave over is packed by best fit,
a length at a time. The plan says which ranks of each length go where; its size depends on the
window, not on the number of documents. Pieces get their ranks by counts a task and length, and
each finds its place in the plan by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listsieve.llm import tokens
from listsieve.llm.tables import stored

WINDOW = 2048
#: Lengths, the most frequent of a half window at most, that patterns of three are built around.
ANCHORS = 64
#: Rounds of the least squares fit.
ROUNDS = 150
#: Shares of the fitted repeat counts that are tried; the rest is packed by best fit.
SHARES = (1.0, 0.8, 0.5)
#: A rank's place in the key of the plan, above it the length.
RANK_BITS = 48


@dataclass
class Patterns:
    """Patterns as three columns of lengths (0: none) and how often each stands in a window."""

    lengths: np.ndarray
    times: np.ndarray

    def used(self, counts: np.ndarray, window: int) -> np.ndarray:
        """Pieces of each length that the patterns take at these repeat counts."""
        weights = self.times * counts[:, None]
        return np.bincount(self.lengths.ravel(), weights.ravel(), window + 1) * (np.arange(window + 1) > 0)


def enumerate_patterns(histogram: np.ndarray, window: int, anchors: int = ANCHORS) -> Patterns:
    """Patterns that fill a window exactly, out of lengths that occur: the window's own, one
    length over and over and one more, or three around the most frequent short ones."""
    occurs = histogram > 0
    occurs[0] = False
    short = np.flatnonzero(occurs[: window // 2 + 1])
    rows = [np.array([[window, 0, 0, 1, 0, 0]])[: int(occurs[window])]]
    for times in range(1, window + 1):
        own = short[short * times <= window]
        if not len(own):
            break
        rest = window - times * own
        exact = own[rest == 0]
        rows.append(np.stack([exact, 0 * exact, 0 * exact, 0 * exact + times, 0 * exact, 0 * exact], 1))
        fits = (rest > 0) & occurs[rest]
        one = np.ones(fits.sum(), np.int64)
        rows.append(np.stack([own[fits], rest[fits], 0 * one, times * one, one, 0 * one], 1))
    every = np.flatnonzero(occurs)
    for a in short[np.argsort(-histogram[short], kind="stable")[:anchors]]:
        third = window - a - every
        fits = (third > 0) & (every <= third)
        fits[fits] = occurs[third[fits]]
        b, c = every[fits], third[fits]
        one = np.ones(len(b), np.int64)
        rows.append(np.stack([a * one, b, c, one, one, one], 1))
    table = np.concatenate(rows)
    return Patterns(table[:, :3], table[:, 3:])


def fit(patterns: Patterns, histogram: np.ndarray, window: int, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts of least squares that are not negative: each round scales a count by the
    quotient of what its lengths ask for and what they are given, which keeps its sign and never
    makes the fit worse. A length weighs by its square, as a long piece left over costs more."""
    if not len(patterns.lengths):
        return np.empty(0)
    weight = np.arange(window + 1, dtype=float) ** 2
    asked = (patterns.times * (weight * histogram)[patterns.lengths]).sum(axis=1)
    counts = np.full(len(patterns.lengths), histogram.sum() / len(patterns.lengths) / 2)
    for _ in range(rounds):
        given = (patterns.times * (weight * patterns.used(counts, window))[patterns.lengths]).sum(axis=1)
        counts *= asked / np.maximum(given, 1e-9)
    return counts


def rounded(patterns: Patterns, counts: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Whole repeat counts (pattern, windows) within what there is, and the histogram of what is
    left. Patterns are rounded together, by their longest length: what one loses the next one
    gets, so that lengths keep their shares and short pieces are not used up."""
    left = histogram.copy()
    taken = []
    order = np.lexsort((counts, -patterns.lengths.max(axis=1)))
    sums = np.floor(np.cumsum(counts[order]) + 0.5).astype(np.int64)
    whole = np.diff(sums, prepend=0)
    for k, windows in zip(order[whole > 0].tolist(), whole[whole > 0].tolist(), strict=True):
        need: dict[int, int] = {}  # a length may stand in two columns
        for n, m in zip(patterns.lengths[k].tolist(), patterns.times[k].tolist(), strict=True):
            if n:
                need[n] = need.get(n, 0) + m
        windows = min([windows, *(int(left[n]) // m for n, m in need.items())])
        if windows:
            taken.append((k, windows))
            for n, m in need.items():
                left[n] -= m * windows
    return taken, left


def best_fit(histogram: np.ndarray, window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of windows (how many, their (length, times)): longest pieces first, each into the
    open windows with the least room that suffices, all windows of a kind at once."""
    done: list[tuple[int, list[tuple[int, int]]]] = []
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, windows: int, held: list[tuple[int, int]]) -> None:
        if windows:
            (open_.setdefault(room, []) if room else done).append((windows, held))

    for length in range(len(histogram) - 1, 0, -1):
        n = int(histogram[length])
        while n:
            room = min((r for r in open_ if r >= length), default=window)
            windows, held = open_[room].pop() if room in open_ else (-(-n // (window // length)), [])
            if room in open_ and not open_[room]:
                del open_[room]
            times = room // length
            full = min(windows, n // times)
            put(room - times * length, full, [*held, (length, times)])
            n -= full * times
            if full < windows and n:
                put(room - n * length, 1, [*held, (length, n)])
                n, full = 0, full + 1
            if held:
                put(room, windows - full, held)
    return done + [kind for kinds in open_.values() for kind in kinds]


@dataclass
class Plan:
    """Ranks ``key`` (length, rank) on go to ``sequence`` on, ``times`` in each, from ``offset``."""

    key: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        at = np.searchsorted(self.key, (length << RANK_BITS) + rank, side="right") - 1
        rank = rank - (self.key[at] & ((1 << RANK_BITS) - 1))
        turn, slot = rank // self.times[at], rank % self.times[at]
        return self.sequence[at] + turn, self.offset[at] + slot * length


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Where the pieces of each length go; ``histogram[n]``: pieces of length n, up to the window."""
    histogram = np.asarray(histogram, np.int64)
    patterns = enumerate_patterns(histogram, window)
    counts = fit(patterns, histogram, window)
    kinds: list[tuple[int, list[tuple[int, int]]]] = []
    for share in SHARES:
        taken, left = rounded(patterns, share * counts, histogram)
        trial = [
            (windows, [(n, m) for n, m in zip(patterns.lengths[k].tolist(), patterns.times[k].tolist(), strict=True) if n])
            for k, windows in taken
        ] + best_fit(left, window)
        if not kinds or sum(w for w, _ in trial) < sum(w for w, _ in kinds):
            kinds = trial
    ranks = np.zeros(window + 1, np.int64)
    rows, sequence = [], 0
    for windows, held in kinds:
        offset = 0
        for length, times in held:
            rows.append(((length << RANK_BITS) + int(ranks[length]), sequence, times, offset))
            ranks[length] += windows * times
            offset += length * times
        sequence += windows
    assert (ranks[1:] == histogram[1:]).all()
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Plan(*columns, sequence)


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all but the first are whole windows."""
    first = n % window or min(n, window)
    return [(0, first), *((at, window) for at in range(first, n, window))] if n else []


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def pieces(docs: DataFrame, path: Callable[[], str], blank_led: bool, end_id: int, window: int) -> DataFrame:
    """The pieces of every document, with the task that cut them and their rank in it among the
    pieces of their length. Written, so that ranks stay as they are."""
    end = np.array([end_id], tokens.ID).tobytes()
    names = [field.split()[0] for field in PIECES.split(", ")]
    kinds = [pa.int32() if field.endswith(" int") else pa.int64() for field in PIECES.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path(), blank_led)
        own = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            keys, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in tokens.chunks(texts, tokens.CHUNK_CHARS):
                rows = []
                for key, ids in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids = memoryview(ids + end)
                    for k, (start, n) in enumerate(cut(len(ids) >> 2, window)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                        rows.append((key, k, start, n, crc, own, seen[n]))
                        seen[n] += 1
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(task, PIECES), "pieces")


def pack(
    docs: DataFrame, path: Callable[[], str], blank_led: bool, end_id: int, window: int = WINDOW
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``
    (doc_id, text), in as few sequences of at most ``window`` ids as the plan finds.

    A document's ids are those of its text (null: none) and ``end_id``, so every row, be it
    repeated, empty or without an id, has a piece; ``doc_id`` is a long. A document of at most
    ``window`` ids stays whole; of a longer one the first piece takes what full windows leave.
    Pieces of one length are alike, so ties go by their task and place in it. No rows give no
    pieces; other columns are not read.
    """
    cuts = pieces(docs, path, blank_led, end_id, window)
    counts = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        histogram[row["length"]] = row["n"]
    places = plan(histogram, window)
    tasks = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(tasks), F.lit(0)).alias("before"))
    ranked = cuts.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.place(batch["length"].to_numpy(), batch["rank"].to_numpy())
                columns = [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    told = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"{told}, sequence_id long, offset long"
    )

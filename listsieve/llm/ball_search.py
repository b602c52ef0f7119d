"""Ranked search of documents by their terms, through ball trees.

Items come in blocks of bounded size. A block's terms are looked for in the whole text of every
document, which gives its sparse vector (other terms cannot score); the vectors are written, so
that statistics and search read the same ones. Each task then groups the vectors of its input,
builds a ball tree over a group, and searches it for every item, with what its earlier groups
have found as the floor. The best of all tasks are ranked last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listsieve.llm.ball_tree import Found, Queries, Tree
from listsieve.llm.tables import stored
from listsieve.llm.words import ALNUM, chunks, split_words

#: Items, and all their terms, of a block; a longer item makes a block of its own.
BLOCK_ITEMS, BLOCK_TERMS = 2048, 1 << 16
#: Rows, and their entries, of a tree; a longer document makes a tree of its own.
TREE_ROWS, TREE_ENTRIES = 1 << 13, 1 << 20
_VECTORS = "doc_id long, n long, terms array<int>, times array<int>"


def item_blocks(items: DataFrame) -> DataFrame:
    """(block, row, item_id, words, times) of ``items`` (item_id, text) with a term at least:
    different terms and how often they occur. A block is cut by one task."""
    kind = items.schema["item_id"].dataType
    shape = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("row", T.LongType()),
            T.StructField("item_id", kind),
            T.StructField("words", T.ArrayType(T.BinaryType())),
            T.StructField("times", T.ArrayType(T.LongType())),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = block = TaskContext.get().partitionId() << 33
        n_items = n_terms = 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in chunks(texts):
                found = split_words(texts[a:b], ALNUM)
                kept, rows = [], []
                for i in range(b - a):
                    words, times = np.unique([found.word(w) for w in range(*found.bounds[i : i + 2])], return_counts=True)
                    if not len(words):
                        continue
                    if n_items and (n_items == BLOCK_ITEMS or n_terms + len(words) > BLOCK_TERMS):
                        block, n_items, n_terms = block + 1, 0, 0
                    n_items, n_terms = n_items + 1, n_terms + len(words)
                    kept.append(a + i)
                    rows.append((block, row, words.tolist(), times.tolist()))
                    row += 1
                blocks, names, words, times = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks, pa.int64()),
                        pa.array(names, pa.int64()),
                        batch["item_id"].take(pa.array(kept, pa.int64())),
                        pa.array(words, pa.list_(pa.binary())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    shape.names,
                )

    return stored(items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, shape), "items")


def vectors(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, times) of every row of ``docs`` (doc_id, text) with a term: all its terms
    with repeats, and which of ``words`` it holds how often. A term is known by 64 bits of its hash
    and its length."""
    found = split_words([w.decode() for w in words], ALNUM)
    order = np.argsort(found.hashes, kind="stable")
    hashes, sizes = found.hashes[order], (found.ends - found.starts)[order]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in chunks(texts):
                own = split_words(texts[a:b], ALNUM)
                n = np.diff(own.bounds)
                at = np.minimum(np.searchsorted(hashes, own.hashes), len(hashes) - 1)
                known = (hashes[at] == own.hashes) & (sizes[at] == own.ends - own.starts)
                key, times = np.unique(own.text[known] * len(hashes) + order[at[known]], return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(b - a + 1) * len(hashes)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (key % len(hashes), times)]
                rows = pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), *lists],
                    ["doc_id", "n", "terms", "times"],
                )
                yield rows.filter(pa.array(n > 0))

    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(task, _VECTORS), "term-vectors")


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms, summed up in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch["terms"].flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for row in rows.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def weight(n_docs: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held + 1)))


def trees(rows: DataFrame, words: list[tuple[int, list[int], list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(row, doc_id, score): the k best documents of each task for each item of ``words`` (row,
    its terms, how often each)."""
    items = [(row, np.array(t), np.array(c) * weights[t]) for row, t, c in words]
    items = [(row, t[w > 0], w[w > 0]) for row, t, w in items if (w > 0).any()]
    bounds = np.cumsum([0, *(len(t) for _, t, _ in items)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not items:
            return
        queries = Queries(bounds, np.concatenate([t for _, t, _ in items]), np.concatenate([w for _, _, w in items]))
        scale = np.sqrt(np.maximum(weights, 1))
        best: list[list[Found]] = [[] for _ in items]
        dense = np.zeros(len(weights), np.int64)

        def search(batch: pa.Table) -> None:
            sizes = batch["terms"].combine_chunks().value_lengths().to_numpy()
            terms = batch["terms"].combine_chunks().flatten().to_numpy()
            times = batch["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch["n"].to_pylist()], np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            values = 1_000_000_000 * times // (1000 * times + 8 * m[owner])
            use = (weights[terms] > 0) & (values > 0)
            left = np.bincount(owner[use], minlength=len(sizes))
            rows = np.flatnonzero(left)
            if not len(rows):
                return
            ids = batch["doc_id"].to_pylist()
            keys = [(0, 0) if ids[i] is None else (1, ids[i]) for i in rows.tolist()]
            tree = Tree(np.append(0, np.cumsum(left[rows])), terms[use], values[use], keys, scale, queries)
            for i, (_, own, w) in enumerate(items):
                dense[own] = w
                tree.search(i, dense, best[i], k)
                dense[own] = 0

        held: list[pa.RecordBatch] = []
        n_rows = n_entries = 0
        for batch in batches:
            ends = np.cumsum(batch["terms"].value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(ends, TREE_ENTRIES - n_entries + (ends[at - 1] if at else 0), side="right")
                stop = min(max(int(room), at + (not held)), at + TREE_ROWS - n_rows, batch.num_rows)
                held.append(batch.slice(at, stop - at))
                n_rows += stop - at
                n_entries += int(ends[stop - 1] - (ends[at - 1] if at else 0)) if stop > at else 0
                at = stop
                if at < batch.num_rows:
                    search(pa.Table.from_batches(held))
                    held, n_rows, n_entries = [], 0, 0
        if n_rows:
            search(pa.Table.from_batches(held))
        for i, (row, _, _) in enumerate(items):
            if best[i]:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(best[i]), pa.int64()),
                        pa.array([d if known else None for _, known, d in best[i]], pa.int64()),
                        pa.array([-s for s, _, _ in best[i]], pa.int64()),
                    ],
                    ["row", "doc_id", "score"],
                )

    return rows.mapInArrow(task, "row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) the ``k`` rows of
    ``docs`` (doc_id, text) with the greatest scores above 0; equal scores by ascending doc_id, a
    null one first.

    Terms are runs of letters, digits and characters above ASCII, A-Z lower-cased. A null text has
    none: such items find nothing, such documents are not counted. Repeated rows of either table
    are rows like others. An empty table gives no rows; other columns are not read. ``doc_id`` is
    cast to long.
    """
    blocks = item_blocks(items)
    found = None
    for block in sorted(r["block"] for r in blocks.select("block").distinct().collect()):
        rows = blocks.where(F.col("block") == block).collect()  # bounded by BLOCK_ITEMS and BLOCK_TERMS
        words = sorted({bytes(w) for r in rows for w in r["words"]})
        place = {w: i for i, w in enumerate(words)}
        held = vectors(docs, words)
        n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.array([weight(n_docs, d) for d in document_counts(held, len(words)).tolist()], np.int64)
        asked = [(r["row"], [place[bytes(w)] for w in r["words"]], list(r["times"])) for r in rows]
        best = trees(held, asked, weights, n_docs, n_terms, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "row long, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
    return ranked.join(blocks.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")

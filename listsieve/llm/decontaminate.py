"""Benchmark decontamination: a prefix-filtered join of document words with item windows.

A window is ten consecutive words of an item (all of a shorter one). A document contains it
only if it contains every shingle of it, so one necessary shingle suffices to find it: the
one that is rarest in the documents. Documents and windows meet on these shingles alone;
length and position then rule out most pairs, and the words themselves decide the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.llm import hash_filter
from listsieve.llm.tables import stored
from listsieve.llm.words import ALNUM, chunks, split_words

WINDOW = 10
SHINGLE = 3


def windows(benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window, n_words, tokens) of every window: its words blank-joined, and the hashes
    of its shingles in order. Items without words have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            items, texts = batch["item_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in chunks(texts):
                found = split_words(texts[a:b], ALNUM)
                hashed = {k: dict(zip(*found.shingles(k)[::-1], strict=True)) for k in range(1, shingle + 1)}
                for i in range(b - a):
                    low, high = found.bounds[i], found.bounds[i + 1]
                    n = min(size, high - low)
                    k = min(shingle, n)
                    for at in range(low, high - n + 1) if n else ():
                        text = b" ".join(found.word(j) for j in range(at, at + n)).decode("utf-8", "surrogatepass")
                        tokens = np.array([hashed[k][j] for j in range(at, at + n - k + 1)], np.uint64)
                        rows.append((items[a + i], text, int(n), tokens.view(np.int64).tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [batch["item_id"].type, pa.string(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["item_id", "window", "n_words", "tokens"],
            )

    key = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(
        cut, f"item_id {key}, window string, n_words int, tokens array<long>"
    )


def counts(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """(token, n): how often shingles that may be wanted occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in chunks(texts):
                found = split_words(texts[a:b], ALNUM)
                hashes = np.concatenate([found.shingles(k)[0] for k in sizes])
                token, n = np.unique(hashes[hash_filter.passes(wanted, hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def necessary(distinct: DataFrame, seen: DataFrame) -> DataFrame:
    """(token, offset, window, n_words) of ``distinct`` windows: the rarest shingle and its place.

    A window with a shingle that no document has occurs nowhere and is left out.
    """
    each = distinct.select("window", "n_words", F.posexplode("tokens").alias("offset", "token"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")
    return (
        each.join(seen, "token", "left")
        .groupBy("window", "n_words")
        .agg(F.min(rarity).alias("rarest"))
        .where("rarest.n > 0")
        .select("rarest.token", "rarest.offset", "window", "n_words")
    )


FOUND = "row long, doc_id long, text_hash long, n_words long, token long, at long, context_at long, context string"


def find(docs: DataFrame, wanted: np.ndarray, sizes: list[int], size: int = WINDOW) -> DataFrame:
    """One row a document, without a token, and one for each of its shingles that may be
    necessary for a window, with the words around it that a window could cover."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch["text"].to_pylist()
            names = list(zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), strict=True))
            for a, b in chunks(texts):
                found = split_words(texts[a:b], ALNUM)
                low, high = found.bounds[:-1], found.bounds[1:]
                out = [
                    (row + i, *names[a + i], n, None, None, None, None) for i, n in enumerate((high - low).tolist())
                ]
                for k in sizes:
                    hashes, places = found.shingles(k)
                    hit = hash_filter.passes(wanted, hashes)
                    for token, at in zip(hashes[hit].view(np.int64).tolist(), places[hit].tolist(), strict=True):
                        i = int(found.text[at])
                        start, stop = max(at - size + k, low[i]), min(at + size, high[i])
                        around = b" ".join(found.word(j) for j in range(start, stop))
                        context = around.decode("utf-8", "surrogatepass")
                        out.append((row + i, None, None, None, token, at - int(low[i]), int(start - low[i]), context))
                row += b - a
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 7 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["row", "doc_id", "text_hash", "n_words", "token", "at", "context_at", "context"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(search, FOUND)


def covered(spans: Column) -> Column:
    """Number of words that spans (start, n), sorted by start, cover together."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(state: Column, s: Column) -> Column:
        stop = s["start"] + s["n"]
        new = F.greatest(stop - F.greatest(s["start"], state["end"]), F.lit(0))
        return F.struct(F.greatest(state["end"], stop).alias("end"), (state["n"] + new).alias("n"))

    return F.aggregate(spans, zero, step, lambda state: state["n"])


def match(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated, text_hash) of every row of ``docs`` (doc_id, text).

    n_hit: words inside any occurrence of any window; items: ids of the items that have one,
    sorted as strings; text_hash: xxhash64 of the text. A null or empty text has no words; repeated rows and ids are judged each
    for itself; an empty table of either kind gives no hits. Other columns are not read.
    """
    every = stored(windows(benchmark), "benchmark-windows")
    distinct = every.groupBy("window", "n_words").agg(F.first("tokens").alias("tokens"))
    lengths = [r["n_words"] for r in every.select("n_words").distinct().collect()]  # at most WINDOW
    sizes = sorted({min(SHINGLE, n) for n in lengths}) or [SHINGLE]
    tokens = every.select(F.explode("tokens").alias("token"))
    seen = counts(docs, hash_filter.collect(tokens, "token"), sizes)
    chosen = stored(necessary(distinct, seen), "necessary-shingles")
    found = stored(find(docs, hash_filter.collect(chosen, "token"), sizes), "shingle-hits")

    hits = found.where("token IS NOT NULL").select("row", "token", "at", "context_at", "context")
    start = F.col("at") - F.col("offset")
    inside = start - F.col("context_at")
    words = F.split("context", " ")
    fits = (inside >= 0) & (inside + F.col("n_words") <= F.size(words))
    same = F.array_join(F.slice(words, F.when(fits, inside + 1).otherwise(1).cast("int"), F.col("n_words")), " ")
    matches = stored(
        hits.join(chosen, "token")
        .where(fits)
        .where(same == F.col("window"))
        .select("row", "window", start.alias("start"), F.col("n_words").cast("long").alias("n")),
        "window-matches",
    )
    spans = matches.groupBy("row").agg(
        covered(F.array_sort(F.collect_set(F.struct("start", "n")))).alias("n_hit")
    )
    items = (
        matches.select("row", "window").distinct()
        .join(every.select("window", F.col("item_id").cast("string").alias("item")), "window")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    documents = found.where("token IS NULL").select("row", "doc_id", "text_hash", "n_words")
    return (
        documents.join(spans, "row", "left")
        .join(items, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            "text_hash",
        )
    )

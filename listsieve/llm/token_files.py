"""Token ids on disk: fixed-width bit packing with block offsets.

A store is a Parquet folder, so Spark's committer makes its writing safe against lost and
repeated tasks on any file system. A row is a block: whole documents until ``BLOCK_IDS`` ids
are reached, their ids in the fewest bits that hold the vocabulary, ``doc_ends`` with the
place behind each document's last id, and ``first``, the block's place in its shard. Eight
ids fill ``width`` bytes, so numpy unpacks any part of a block that starts at a multiple of
eight without reading what lies before. Shards ascend by doc_id, and so do blocks in them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listsieve.llm import tokens
from listsieve.llm.tables import stored

BLOCK_IDS = 1 << 16
BLOCK = (
    "shard int, block int, first long, n_ids long, width int, "
    "doc_ids array<long>, doc_ends array<long>, payload binary"
)
ARROW_BLOCK = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def width_of(vocabulary: int) -> int:
    """Fewest bits for the ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids one after the other, ``width`` bits each, least significant bit first."""
    rows = np.zeros((-(-len(ids) // 8), width + 8), np.uint8)
    lanes = np.zeros(len(rows) * 8, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 8)
    for lane in range(8):
        at, shift = divmod(lane * width, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(width + shift) // 8)):
            rows[:, at + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return rows[:, :width].tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (excluded) of a payload; only their bytes are touched."""
    low, high = start // 8, -(-stop // 8)
    raw = np.frombuffer(payload, np.uint8, (high - low) * width, low * width).reshape(-1, width)
    out = np.empty((high - low, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(8):
        at, shift = divmod(lane * width, 8)
        value = np.zeros(len(raw), np.uint64)
        for k in range(-(-(width + shift) // 8)):
            value |= raw[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[start - low * 8 : stop - low * 8]


def write(
    docs: DataFrame, name: str, path: Callable[[], str], blank_led: bool, end_id: int, vocabulary: int
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into a new store; its blocks.

    Every document ends with ``end_id``; a null text is empty. Rows of one doc_id follow in
    the order of their texts; a null doc_id comes first. No rows give an empty store.
    """
    width = width_of(vocabulary)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], tokens.ID).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path(), blank_led)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, ends = [], [], []
        total = 0

        def flush() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(ids), tokens.ID), width)
            row = [shard, block, first, total, width, doc_ids, ends, payload]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, ARROW_BLOCK, strict=True)], schema=ARROW_BLOCK
            )

        for batch in batches:
            keys, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in tokens.chunks(texts, tokens.CHUNK_CHARS):
                for key, found in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids += [found, end]
                    total += len(found) // 4 + 1
                    doc_ids.append(key)
                    ends.append(total)
                    if total >= BLOCK_IDS:
                        yield flush()
                        block, first, total = block + 1, first + total, 0
                        ids, doc_ids, ends = [], [], []
        if doc_ids:
            yield flush()

    return stored(rows.mapInArrow(encode, BLOCK), name)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, shard_start): the ids of all shards before it. One narrow row a shard."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from a store's blocks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                shard, _, first, n, width, doc_ids, ends, payload = (c[row].as_py() for c in batch.columns)
                ids = unpack(payload, width, 0, n).astype(tokens.ID)
                begin = 0
                for key, stop in zip(doc_ids, ends, strict=True):
                    out.append((key, shard, first + begin, stop - begin, zlib.crc32(ids[begin:stop])))
                    begin = stop
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
            )

    found = blocks.mapInArrow(check, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(blocks), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_range(blocks: DataFrame, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole store; only blocks that hold some are read."""
    placed = blocks.join(shard_starts(blocks), "shard").withColumn("at", F.col("shard_start") + F.col("first"))
    wanted = placed.where((F.col("at") < stop) & (F.col("at") + F.col("n_ids") > start)).orderBy("at")
    parts = []
    for row in wanted.select("at", "n_ids", "width", "payload").toLocalIterator():
        low, high = max(start - row["at"], 0), min(stop - row["at"], row["n_ids"])
        parts.append(unpack(bytes(row["payload"]), row["width"], low, high))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)

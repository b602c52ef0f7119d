"""The prefix trie of conversations, out of whole sequences.

Conversations with the same turns collapse into one weighted sequence first, with the list of
its conversations. Sequences that are proper prefixes of others are told by an anti-join; the
rest are the leaves. The prefixes of the different sequences are then the nodes, with the
sequences' weights summed up. What a node says of its subtree is summed along sequences: a node
belongs to the least conversation that passes through it, each sequence sums what it owns from
its end on, and the nodes add up the sums of the sequences that pass through them. So nothing
goes level by level, and the depth of the trie costs no rounds.

A sequence is known by 128 bits, the exclusive or of hashes of (depth, turn); so a prefix's hash
is a running aggregate. Running aggregates go by chunks of ``CHUNK`` turns with the sums of the
chunks before them, and turns get their places by ranges of the sorted table: no conversation,
however long, and no node, however many pass through it, has to fit into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listsieve.llm.tables import stored

#: Turns that a running aggregate handles at a time.
CHUNK = 4096
#: Turns that may come from another conversation are fewer than this, and conversations in a block.
MOST, BLOCK = 9, 5
#: Parts that the lookups of one parent are spread over.
PARTS = 64


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, h1, h2, bytes): the turns of each conversation, in parts of the sorted
    table; ``at`` counts in the part. Order: turn (null first), then role and text; a null role or
    text is empty. Rows without a conv_id are in no conversation.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(
        rows.select(
            "conv_id",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
            F.xxhash64("role", "text").alias("h1"),
            F.xxhash64(F.lit(1), "text", "role").alias("h2"),
            F.octet_length("text").cast("long").alias("bytes"),
        ),
        "turns",
    )


def heads(turns: DataFrame) -> DataFrame:
    """(conv_id, part, first, before): the first place of a conversation in each part, and its
    turns in the parts before. A row a conversation, or one a part of a very long one."""
    counts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def borrowed(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first one of its block: crc32 of its decimal id
    modulo ``MOST``."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, bytes) of the rebuilt conversations, and a row of depth 0 for each.

    A conversation c starts with the first h turns of c - c % 5 (all if fewer, none if absent;
    the remainder has the sign of c) and goes on with its own after its first h.
    """
    turns = numbered(conversations)
    tops = stored(heads(turns), "heads")
    sizes = tops.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), borrowed(F.col("conv_id")).alias("h"))
    lent = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(MOST)).alias("lent"))
    convs = convs.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "taken"), "convs")

    placed = tops.join(convs, "conv_id").select("conv_id", "part", "first", "before", "h", "taken")
    own = turns.join(placed, ["conv_id", "part"]).withColumn("at", F.col("at") - F.col("first") + F.col("before"))
    after = own.where("at >= h").withColumn("depth", F.col("at") - F.col("h") + F.col("taken") + 1)
    # the first turns of a block's first conversation, for all that borrow some: a few rows a block
    start = own.where(f"at < {MOST} AND conv_id % {BLOCK} = 0").select(F.col("conv_id").alias("base"), "at", "h1", "h2", "bytes")
    taken = convs.where("taken > 0").select("conv_id", "base", "taken").join(start, "base").where("at < taken")
    names = ["conv_id", "depth", "h1", "h2", "bytes"]
    none = [F.lit(0).cast("long").alias(c) for c in names[1:]]
    return (
        after.select(names)
        .unionByName(taken.withColumn("depth", F.col("at") + 1).select(names))
        .unionByName(convs.select("conv_id", *none))
    )


def sequences(steps: DataFrame) -> DataFrame:
    """(conv_id, k1, k2, depth) of every conversation of ``steps`` (conv_id, depth, e1, e2)."""
    return steps.groupBy("conv_id").agg(F.bit_xor("e1").alias("k1"), F.bit_xor("e2").alias("k2"), F.max("depth").alias("depth"))


def running(rows: DataFrame, carried: dict[str, Callable[[str], Column]], forward: bool) -> DataFrame:
    """``rows`` (seq, chunk, depth, ..) with running aggregates, up to and with the row's own
    depth (or from it on, where not ``forward``). ``carried`` names each column's aggregate; the
    result has the one inside the chunk, and as ``_name`` that of the chunks before."""
    rank = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    totals = rows.groupBy("seq", "chunk").agg(*(agg(name).alias(name) for name, agg in carried.items()))
    earlier = Window.partitionBy("seq").orderBy(rank("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("seq", "chunk", *(agg(name).over(earlier).alias(f"_{name}") for name, agg in carried.items()))
    inside = Window.partitionBy("seq", "chunk").orderBy(rank("depth")).rowsBetween(Window.unboundedPreceding, 0)
    for name, agg in carried.items():
        rows = rows.withColumn(name, agg(name).over(inside))
    return rows.join(totals, ["seq", "chunk"])


def joined_ends(members: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of ``members`` (k1, k2, depth, conv_id): the SHA-256 of each
    sequence's conversations, ascending, with commas between.

    Sorted ranges write pieces of the lists, at most a batch of rows each; the pieces of a list
    then run through one hash. So a list is never held as a whole.
    """
    key = ["k1", "k2", "depth"]

    def runs(columns: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(columns[0]), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[:1] = True
        return np.append(np.flatnonzero(new), len(new))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = runs([batch[c].to_numpy() for c in key])
            ids = batch["conv_id"].to_pylist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            places = np.arange(place, place + len(texts))
            place += len(texts)
            heads = [batch[c].take(pa.array(bounds[:-1])) for c in key]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(places), pa.array(texts, pa.string())], [*key, "place", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *name, ids in zip(*(batch[c].to_pylist() for c in [*key, "ids"]), strict=True):
                if name == own:
                    state.update(f",{ids}".encode())
                    continue
                if own is not None:
                    out.append((*own, state.hexdigest()))
                own, state = name, hashlib.sha256(ids.encode())
            yield told(out)
        if own is not None:
            yield told([(*own, state.hexdigest())])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*key, "ends_sha256"])

    shape = "k1 long, k2 long, depth long"
    order = [*key, "conv_id"]
    pieces = members.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(cut, f"{shape}, place long, ids string")
    whole = pieces.repartition(*key).sortWithinPartitions(*key, "place")
    return whole.mapInArrow(digest, f"{shape}, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth from 1, h1, h2, bytes, and a row of
    depth 0 for every conversation): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Conversations with the same turns are members of the same nodes; a conversation without
    turns is a member of the root alone. No conversations give no nodes.
    """
    salted = [F.xxhash64("depth", "h1", "h2"), F.xxhash64("h2", "depth", "h1")]
    here = [F.when(F.col("depth") > 0, e).otherwise(F.lit(0).cast("long")).alias(n) for e, n in zip(salted, ("e1", "e2"), strict=True)]
    steps = stored(turns.select("conv_id", "depth", *here, "bytes"), "steps")
    key = ["k1", "k2", "depth"]

    # whole sequences, each with its weight and its least conversation
    members = stored(sequences(steps), "members")
    whole = stored(members.groupBy(*key).agg(F.count("*").alias("weight"), F.min("conv_id").alias("seq")), "sequences")

    # the prefixes of each sequence; chunks spread a long one
    chunk = F.floor(F.col("depth") / CHUNK).cast("long")
    chosen = whole.select("seq", "weight", F.col("depth").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), chunk)).alias("chunk"))
    rows = steps.withColumnRenamed("conv_id", "seq").withColumn("chunk", chunk).join(chosen, ["seq", "chunk"])
    rows = rows.withColumn("k1", F.col("e1")).withColumn("k2", F.col("e2"))
    rows = running(rows, {"k1": F.bit_xor, "k2": F.bit_xor}, forward=True)
    for k in ("k1", "k2"):
        rows = rows.withColumn(k, F.col(k).bitwiseXOR(F.coalesce(f"_{k}", F.lit(0).cast("long"))))
    up = [F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)]
    paths = stored(rows.select("seq", "chunk", "depth", "k1", "k2", *up, "bytes", "weight", "length"), "paths")

    # a node belongs to the least conversation that passes through it
    nodes = paths.groupBy(*key).agg(
        F.sum("weight").alias("n_convs"),
        F.min("seq").alias("conv_id"),
        F.max("bytes").alias("bytes"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
    )
    nodes = stored(nodes, "nodes")
    inner = paths.where("depth < length").select(*key).distinct()
    leaves = whole.join(inner, key, "left_anti").select(*key, F.lit(1).cast("long").alias("leaf"))

    # along each sequence, what its own nodes hold from there to its end
    owned = nodes.join(leaves, key, "left").select(
        F.col("conv_id").alias("seq"),
        chunk.alias("chunk"),
        "depth",
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        F.coalesce("leaf", F.lit(0).cast("long")).alias("leaves"),
    )
    sums = ["saved", "leaves"]
    held = paths.select("seq", "chunk", *key).join(owned, ["seq", "chunk", "depth"], "left").fillna(0, sums)
    held = running(held, dict.fromkeys(sums, F.sum), forward=False)
    under = held.groupBy(*key).agg(*(F.sum(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums))

    # only the first node that a sequence owns has a parent of another sequence
    parent = [F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    first = nodes.where("depth > 0").groupBy("conv_id").agg(F.min_by(F.struct("p1", "p2", "depth"), "depth").alias("node"))
    first = first.select("conv_id", "node.*").select("conv_id", F.pmod(F.xxhash64("conv_id"), F.lit(PARTS)).alias("slot"), *parent)
    asked = first.select(*key, "slot").distinct().join(nodes.select(*key, F.col("conv_id").alias("parent")), key)
    found = first.join(asked, [*key, "slot"]).select("conv_id", (F.col("depth") + 1).alias("depth"), "parent")

    children = nodes.where("depth > 0").select(*parent).groupBy(*key).agg(F.count("*").alias("n_children"))
    told = nodes.drop("p1", "p2", "bytes").join(children, key, "left").join(under, key).join(joined_ends(members), key, "left")
    return told.join(found, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )

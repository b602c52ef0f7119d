"""Jaccard self-join of documents on word shingles, by count vectors in a tree.

Documents with equal shingle sets form a class first, and one row stands for it. Two sets
that are 75 % alike share one of the first quarter of their shingles, in any one order of
all shingles; so sets meet only under such shingles (frequent ones come last in the order,
which keeps the groups small). In each group a set is held against the group's first one, and where
that leaves several components against a neighbour as well;
exact links join nearly all copies there. Where the rest of a group, which has met its first
one, then still has several components, its sets' shingle counts by hash group are indexed as
points in a tree, which yields the pairs between components that the summed coordinate minima
allow. Groups of the same sets are searched once; a large group is split into blocks, and each
pair of blocks gets trees of its own. These pairs are verified exactly as well. So pairs inside a component need not be listed, and no link between two
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listsieve.llm import components, count_tree, hash_filter
from listsieve.llm.tables import discard, stored
from listsieve.llm.words import NON_SPACE, chunks, mix, run_hash, split_words

WORDS = 5
#: Groups that shingles are hashed into: the coordinates of a point in the tree, and the finer
#: ones that a pair must pass before whole sets are fetched.
GROUPS, FINE = 64, 512
#: Bits of a shingle that sets meet under; a chance meeting is sorted out later.
TOKEN_BITS = 48
#: Shingles that come last in the order: at most so many, seen at least so often in a block of
#: ``BLOCK`` shingles of some task. They only steer the order, not the result.
FREQUENT, SEEN, BLOCK = 1 << 16, 8, 2 << 20
#: Rows of a group that go into one tree; a larger group is split into blocks of about so many.
TREE_ROWS = 4096
#: Sizes in one band differ by less than this factor. Linked sets differ by at most 4/3, so they
#: are in the same band or in neighbouring ones.
BAND = 1.5
#: Pairs that a task holds before it hands them on.
HELD = 1 << 16


def sets_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. Fewer words than a shingle has make
    one shingle; no words, or no text, none."""
    for a, b in chunks(texts):
        found = split_words(texts[a:b], NON_SPACE)
        hashes, first = found.shingles(WORDS)
        bounds = np.searchsorted(found.text[first], np.arange(b - a + 1))
        for i in range(b - a):
            own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
            if 0 < len(own) < WORDS:
                yield np.array([run_hash(own)], np.uint64)
            else:
                yield np.unique(hashes[bounds[i] : bounds[i + 1]])


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    with np.errstate(over="ignore"):
        a = shingles.sum(dtype=np.uint64) + np.uint64(len(shingles))
        b = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return tuple(mix(np.array([a, b])).view(np.int64).tolist())


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The shingles that occur in most sets, most frequent last; at most ``FREQUENT``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, set()

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64),) * 2
            often = n >= SEEN
            return pa.RecordBatch.from_arrays(
                [pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"]
            )

        for batch in batches:
            for own in sets_of(batch["text"].to_pylist()):
                key = signature(own)
                if key in known:
                    continue
                known.add(key)
                held.append(own)
                size += len(own)
                if size >= BLOCK:
                    yield flush()
                    held, size, known = [], 0, set()
        yield flush()

    seen = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.array([r["token"] for r in reversed(top)], np.int64).view(np.uint64)


class Order:
    """The order of all shingles: by hash, then the frequent ones by frequency."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent, kind="stable")
        self.sorted = frequent[self.rank]

    def first(self, shingles: np.ndarray) -> np.ndarray:
        """The first quarter of an ascending set and one more: no partner misses all of them."""
        need = len(shingles) // 4 + 1
        if not len(self.sorted):
            return shingles[:need]
        at = np.minimum(np.searchsorted(self.sorted, shingles), len(self.sorted) - 1)
        last = self.sorted[at] == shingles
        rare = shingles[~last]
        if len(rare) >= need:
            return rare[:need]
        frequent = shingles[last][np.argsort(self.rank[at[last]], kind="stable")]
        return np.concatenate([rare, frequent[: need - len(rare)]])


def fine_counts(shingles: np.ndarray) -> bytes:
    """Counts of the finer groups, a byte each, or two where one does not fit; all 65535 where
    that is too little as well."""
    counts = np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=FINE)
    if counts.max() < 256:
        return counts.astype(np.uint8).tobytes()
    return (counts if counts.max() < 65535 else np.full(FINE, 65535)).astype("<u2").tobytes()


def points_of(column: pa.Array) -> np.ndarray:
    """Rows of finer counts; a set too large for them counts as unbounded everywhere."""
    rows = column.to_pylist()
    if all(len(r) == FINE for r in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, FINE).astype(np.int32)
    fine = np.stack([np.frombuffer(r, np.uint8 if len(r) == FINE else "<u2") for r in rows]).astype(np.int32)
    fine[(fine == 65535).any(axis=1)] = 1 << 20
    return fine


FEATURES = "row long, doc_id long, text_hash long, n long, sig1 long, sig2 long, tokens array<long>, counts binary"


def features(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One row a document: size and signature of its set, the shingles it meets others under,
    and its point."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, order = TaskContext.get().partitionId() << 33, Order(frequent)
        for batch in batches:
            texts = batch["text"].to_pylist()
            names = list(zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), strict=True))
            for a in range(0, len(texts), 512):
                out = []
                for name, own in zip(names[a : a + 512], sets_of(texts[a : a + 512]), strict=True):
                    mask = np.uint64((1 << TOKEN_BITS) - 1)
                    tokens = np.unique(order.first(own) & mask).astype(np.int64) if len(own) else np.empty(0, np.int64)
                    out.append((row, *name, len(own), *signature(own), tokens, fine_counts(own)))
                    row += 1
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:6]]
                ends = np.cumsum([0, *map(len, columns[6])])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(columns[6]))))
                arrays += [pa.array(c, pa.binary()) for c in columns[7:]]
                yield pa.RecordBatch.from_arrays(
                    arrays, ["row", "doc_id", "text_hash", "n", "sig1", "sig2", "tokens", "counts"]
                )

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return stored(hashed.mapInArrow(task, FEATURES), "set-features", "zstd")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, sig1, sig2, text_hash), out of the texts once more. A
    bitmap of the text hashes tells which texts to split at all."""
    wanted = hash_filter.collect(nodes, "text_hash")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # a copy has the same set
        for batch in batches:
            hashes = batch["text_hash"].to_numpy()
            some: dict[int, int] = {}
            for i in np.flatnonzero(hash_filter.passes(wanted, hashes.view(np.uint64))).tolist():
                if (key := int(hashes[i])) not in told:
                    told.add(key)
                    some[key] = i
            texts = batch["text"].take(pa.array(list(some.values()), pa.int64())).to_pylist()
            for a in range(0, len(texts), 512):
                out: dict[tuple[int, int], bytes] = {}
                for own in sets_of(texts[a : a + 512]):
                    if len(own):
                        out[signature(own)] = own.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in out], pa.int64()),
                        pa.array([k[1] for k in out], pa.int64()),
                        pa.array(list(out.values()), pa.binary()),
                    ],
                    ["sig1", "sig2", "shingles"],
                )

    hashed = docs.select("text", F.xxhash64("text").alias("text_hash"))
    found = hashed.mapInArrow(task, "sig1 long, sig2 long, shingles binary")
    once = found.dropDuplicates(["sig1", "sig2"]).join(nodes.drop("text_hash"), ["sig1", "sig2"])
    return stored(once.select("node", "shingles"), "sets", "zstd")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets overlap by 75 % of their union."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                own, other = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * shared >= 75 * (len(own) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(task, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = stored(nodes.join(classes.select("node", "sig1", "sig2", "text_hash"), "node"), "pair-nodes")
    sets = shingle_sets(docs, nodes)
    links = stored(linked(pairs, sets), "links")
    discard(pairs, nodes, sets)
    return links


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that their sizes and the summed minima of their counts allow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                overlap = np.minimum(points_of(some["x"]), points_of(some["y"])).sum(axis=1)
                keep = count_tree.may_link(overlap, some["m"].to_numpy() + some["n"].to_numpy())
                yield some.select(["a", "b"]).filter(pa.array(keep))

    sizes = [points.select(F.col("node").alias(c), F.col("n").alias(n)) for c, n in (("a", "m"), ("b", "n"))]
    sized = pairs.join(sizes[0], "a").join(sizes[1], "b").where("4 * least(m, n) >= 3 * greatest(m, n)")
    a = points.select(F.col("node").alias("a"), F.col("counts").alias("x"))
    b = points.select(F.col("node").alias("b"), F.col("counts").alias("y"))
    return sized.join(a, "a").join(b, "b").mapInArrow(task, "a long, b long")


def blocks(groups: DataFrame) -> DataFrame:
    """``groups`` (token, node, component, n) with ``block`` and ``right``: rows of a token and block
    are to be held against each other, or, where some are ``right``, those against the rest.

    A group of at most ``TREE_ROWS`` is one block. A larger one is split by bands of size, then by
    a hash of the node; each row goes to every pair of its own block with one that links may
    reach, and two rows meet in one pair only.
    """
    banded = groups.withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    counts = banded.groupBy("token", "band").agg(F.count("*").alias("rows"))
    part = F.struct("band", F.ceil(F.col("rows") / TREE_ROWS).cast("int").alias("parts"))
    large = counts.groupBy("token").agg(F.sum("rows").alias("rows"), F.map_from_entries(F.collect_list(part)).alias("parts"))
    large = large.where(F.col("rows") > TREE_ROWS).drop("rows")

    def parts(step: int) -> Column:
        return F.coalesce(F.try_element_at("parts", F.col("band") + step), F.lit(0))

    def others(step: int) -> Column:
        return F.when(parts(step) > 0, F.sequence(F.lit(0), parts(step) - 1)).otherwise(F.array().cast("array<int>"))

    def pair(up: int, band: Column, i: Column, j: Column, right: Column) -> Column:
        name = F.lit(64 * up).cast("long") + band
        for x in (i, j):
            name = name * (1 << 28) + x
        return F.struct(name.alias("block"), right.alias("right"))

    own, band = F.col("own"), F.col("band")
    joined = banded.join(large, "token", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.greatest(parts(0), F.lit(1))).cast("int"))
    met = F.concat(
        F.transform(others(0), lambda x: pair(0, band, F.least(own, x), F.greatest(own, x), own > x)),
        F.transform(others(1), lambda x: pair(1, band, own, x, F.lit(False))),
        F.transform(others(-1), lambda x: pair(1, band - 1, x, own, F.lit(True))),
    )
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.lit(False).alias("right")))
    split = joined.withColumn("pair", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(met)))
    return split.select("token", "node", "component", "n", "pair.block", "pair.right")


def tree_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of different components in each block of ``groups`` (token, block, right, node,
    component, n, counts), found by the tree and passed by the finer counts; rows of a
    block come together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def told(found: set[tuple[int, int]]) -> pa.RecordBatch:
            columns = list(zip(*sorted(found), strict=True)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        def starts_of(table: pa.Table) -> np.ndarray:
            token, block = table["token"].to_numpy(), table["block"].to_numpy()
            return np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1]), True])

        def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
            node, right = table["node"].to_numpy(), table["right"].to_numpy()
            label, sizes = table["component"].to_numpy(), table["n"].to_numpy()
            fine = table["counts"].combine_chunks()
            points = points_of(fine).reshape(-1, GROUPS, FINE // GROUPS).sum(axis=2)
            starts = starts_of(table)
            found: set[tuple[int, int]] = set()
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                if high - low < 2:
                    continue
                own = slice(low, high)
                for x, y in count_tree.pairs(points[own], sizes[own], label[own], right[own]):
                    keep = passed(fine, low + x, low + y, sizes[own][x] + sizes[own][y])
                    a, b = node[own][x[keep]], node[own][y[keep]]
                    found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
                    if len(found) >= HELD:
                        yield told(found)
                        found.clear()
            yield told(found)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            cut = int(starts_of(table)[-2])  # the last block may go on
            if cut:
                yield from search(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield from search(rest)

    return groups.mapInArrow(task, "a long, b long").distinct()


def several(met: DataFrame, links: DataFrame, once: bool = False) -> DataFrame:
    """(token, node, component) of the groups with several components; with ``once``, of groups
    of the same nodes only the one with the least token."""
    joined = stored(components.components(links), "components")
    placed = met.select("token", "node").join(joined, "node", "left")
    placed = placed.select("token", "node", F.coalesce("component", "node").alias("component"))
    groups = placed.groupBy("token").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    groups = groups.where("low < high")
    if once:
        groups = groups.groupBy("size", "x", "y").agg(F.min("token").alias("token"))
    return placed.join(groups.select("token"), "token")


def passed(fine: pa.Array, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs of rows the finer counts allow as well."""
    keep = [np.empty(0, bool)]
    for i in range(0, len(x), 512):
        a, b = (points_of(fine.take(pa.array(v[i : i + 512]))) for v in (x, y))
        keep.append(count_tree.may_link(np.minimum(a, b).sum(axis=1), sizes[i : i + 512]))
    return np.concatenate(keep)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) of every row of ``docs`` (doc_id, text).

    Rows are linked if 100 * intersection >= 75 * union of their sets; component_id is the least
    doc_id that links reach; text_hash, xxhash64 of the text, tells rows of one id apart. A null
    or wordless text has an empty set and no links. Repeated rows and ids are rows like others;
    an empty table gives none. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    found = features(docs, frequent_shingles(docs))
    rows = stored(found.select("row", "doc_id", "text_hash", "n", "sig1", "sig2"), "set-rows")
    full = rows.where("n > 0")
    # one class for each different set, named by one of its rows
    classes = full.groupBy("sig1", "sig2").agg(
        F.min("row").alias("node"),
        F.min_by("text_hash", "row").alias("text_hash"),
        F.min("doc_id").alias("least_id"),
    )
    classes = stored(classes, "set-classes")
    named = found.select(F.col("row").alias("node"), "n", "tokens", "counts").join(classes.select("node"), "node", "left_semi")

    # sets that meet under a shingle
    postings = named.select("node", F.explode("tokens").alias("token"))
    group = Window.partitionBy("token")
    met = postings.withColumn("first", F.min("node").over(group)).withColumn("size", F.count("*").over(group))
    met = stored(met.where("size > 1").select("token", "node", "first"), "meetings")
    points = stored(
        named.select("node", "n", "counts").join(met.select("node").distinct(), "node", "left_semi"), "points", "zstd"
    )

    discard(found)

    # every set against the first of its groups
    pairs = met.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(docs, stored(bounded(pairs, points), "pairs"), classes)

    # where the rest of a group still has several components: each set against the one before it in
    # an order of the group's own, so a set tries as many others as it has shingles
    rest = met.where("node <> first")
    beside = Window.partitionBy("token").orderBy(F.xxhash64("token", "node"))
    tried = several(rest, links).withColumn("other", F.lag(F.struct("component", "node")).over(beside))
    tried = tried.where("component <> other.component")
    pairs = tried.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"))
    links = links.unionByName(verified(docs, stored(bounded(pairs.distinct(), points), "pairs"), classes))

    # what then is left goes into the tree
    groups = stored(several(rest, links, once=True).join(points.select("node", "n"), "node"), "several")
    split = blocks(groups).join(points.drop("n"), "node")
    split = split.repartition("token", "block").sortWithinPartitions("token", "block")
    pairs = tree_pairs(split.select("token", "block", "right", "node", "component", "n", "counts"))
    links = links.unionByName(verified(docs, stored(pairs, "pairs"), classes))

    discard(met, points, groups)

    final = components.components(links)
    reached = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = reached.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named_ids = reached.join(ids, "component").select("sig1", "sig2", "component_id")
    return (
        rows.select("doc_id", "text_hash", "n", "sig1", "sig2")
        .join(named_ids, ["sig1", "sig2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            "text_hash",
        )
    )

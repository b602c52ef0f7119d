"""Document fingerprints: bottom-k sketches of word shingles. DataFrame functions only.

A sketch is the ``K`` least distinct 48-bit hashes of a text's shingles, ascending. The
sketch of two parts together is the bottom k of their sketches' union, so sketches merge.
As text, a fingerprint is the hashes one after the other, twelve hex digits each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
HASH_BITS = 48
DIGITS = HASH_BITS // 4
#: Bytes that part words, as in ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """A-Z lower-cased words of a text; none for null."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), SPACE), lambda w: w != "")


def hashes_of(word_hashes: Column) -> Column:
    """Hashes of all shingles of a text, given its words' hashes. Fewer words than a shingle
    has make one shingle, no words none."""
    n = F.size(word_hashes)
    run = lambda i: F.shiftrightunsigned(
        F.xxhash64(*[F.get(word_hashes, i + j) for j in range(WORDS)]), 64 - HASH_BITS
    )
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), run)
    )


def bottom(hashes: Column, k: int = K) -> Column:
    """The k least distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(docs: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """``docs`` with the sketch of a text column; each step is a projection of its own."""
    hashed = docs.withColumn("_hashes", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    return hashed.withColumn(name, bottom(hashes_of(F.col("_hashes")), k)).drop("_hashes")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty sketches are alike."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = F.element_at(a, k).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1) * float(1 << HASH_BITS) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def encoded(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def decoded(fingerprint: Column) -> Column:
    """The sketch that a fingerprint holds."""
    parts = F.regexp_extract_all(fingerprint, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))
    return F.transform(parts, lambda p: F.conv(p, 16, 10).cast("bigint"))


# --- the document after each one ---------------------------------------------------------


def bucket_of(doc_id: Column, cuts: Sequence[int]) -> Column:
    """Number of cuts below an id; a null id lies below all."""
    if not cuts:
        return F.lit(0)
    below = F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c < doc_id)
    return F.coalesce(F.size(below), F.lit(0))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``sketch``, ``next_text`` and ``next_sketch``: those of the
    next row by descending doc_id (ties by descending text, nulls last); after the last row,
    of the first.

    Rows are dealt to ranges of ids cut at their quantiles. Each range also gets a copy of the
    first row of the next lower range (the lowest one, of the first row of all), so a window
    within the range suffices. Only cuts and the ranges' greatest ids reach the driver.
    """
    spark = docs.sparkSession
    shares = [i / buckets for i in range(1, buckets)]
    cuts: list[int] = []
    if shares:
        found = docs.agg(F.percentile_approx("doc_id", shares, 100 * buckets).alias("c")).first()["c"] or []
        cuts = sorted(set(found))
    placed = docs.withColumn("_bucket", bucket_of(F.col("doc_id"), cuts))
    tops = {r["_bucket"]: r["top"] for r in placed.groupBy("_bucket").agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(tops)
    copies = [(used[i - 1], used[i]) for i in range(len(used))]  # from a range to the one above; the last to the first
    hop = spark.createDataFrame(
        [(a, b, tops[a]) for a, b in copies], "_bucket int, _above int, _top long"
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    heads = (
        placed.join(F.broadcast(hop), "_bucket")  # one row a range: at most ``buckets``
        .where(F.col("doc_id").eqNullSafe(F.col("_top")))
        .groupBy("_above", "doc_id")
        .agg(F.max("text").alias("text"))
        .select("doc_id", "text", F.col("_above").alias("_bucket"), F.lit(True).alias("_copy"))
    )
    rows = placed.select("doc_id", "text", "_bucket", F.lit(False).alias("_copy")).unionByName(heads)
    in_range = Window.partitionBy("_bucket").orderBy("_copy", *order)
    rows = with_sketch(rows, "text", "sketch")
    for name in ("text", "sketch"):
        rows = rows.withColumn(f"next_{name}", F.lead(name).over(in_range))
    return rows.where(~F.col("_copy")).drop("_bucket", "_copy")


def edited_text(text: Column, after: Column) -> Column:
    """The last third (rounded down) of ``text`` replaced by the start of ``after``."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(F.coalesce(after, F.lit("")), F.lit(1), third))

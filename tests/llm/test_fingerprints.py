"""Sketches against exact shingle sets, and the next document against a sorted list."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from listsieve.llm import fingerprints as fp
from listsieve.llm.queries import QUERIES


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture
def texts(rng, odd_texts):
    long = [" ".join(f"w{rng.randint(0, 5)}{rng.choice('abé')}" for _ in range(rng.randint(0, 300))) for _ in range(40)]
    return long + odd_texts + long[:3]


def test_query(spark, documents, texts, tables):
    folder = tables(documents=documents(*texts, first=100).repartition(3))
    got = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, folder).collect()}
    plain = [t or "" for t in texts]
    prints = {}
    for i, text in enumerate(plain):
        after, third, r = plain[i - 1], len(text) // 3, got[100 + i]  # the first one is followed by the last
        edited = text[: len(text) - third] + after[:third]
        a, b, c = map(shingles, (text, edited, after))
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        exact = len(a | b) <= fp.K
        assert r.near_edited == pytest.approx(likeness(a, b), abs=1e-9 if exact else 0.2)
        assert r.near_next == pytest.approx(likeness(a, c), abs=1e-9 if len(a | c) <= fp.K else 0.2)
        assert r.distinct_shingles == pytest.approx(len(a), rel=1e-9 if len(a) < fp.K else 0.4)
        assert len(r.fingerprint) == fp.DIGITS * min(len(a), fp.K)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(got) == len(texts)


def test_sketches_merge_and_come_back(documents):
    both = documents("a b c d e f g h i j", "a b c d e f x y z q")
    rows = fp.with_sketch(both, "text", "sketch").select("sketch", fp.decoded(fp.encoded(F.col("sketch"))).alias("back"))
    (a, a2), (b, b2) = rows.collect()
    assert (a, b) == (a2, b2)
    whole = sorted(set(a) | set(b))
    merged = both.sparkSession.createDataFrame([(a, b)], "a array<long>, b array<long>").select(
        fp.merged(F.col("a"), F.col("b")), fp.merged(F.col("a"), F.col("b"), 3), fp.containment(F.col("a"), F.col("b"))
    )
    all_of, least, part = merged.first()
    assert (all_of, least, part) == (whole, whole[:3], pytest.approx(2 / 6))


def test_next_of_ties_and_nulls(spark):
    rows = [(None, "n"), (5, "b"), (5, "a"), (5, "a"), (9, None), (-3, "low")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), [-ord(c) for c in r[1] or "\uffff"]))
    for buckets in (1, 3, 16):
        got = fp.with_next(docs, buckets).select("doc_id", "text", "next_text").collect()
        want = [(*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert fp.with_next(docs.limit(0), 4).count() == 0
    assert [r.next_text for r in fp.with_next(docs.where("doc_id = 9"), 4).collect()] == [None]

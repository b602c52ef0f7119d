"""Packing by patterns: every id once, whole documents, about as few sequences as can be."""

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listsieve.llm import pattern_packing
from listsieve.llm.queries import BYTE_BPE, QUERIES


def histogram(lengths, window):
    return np.bincount(lengths, minlength=window + 1)


def laid_out(plan, lengths):
    """sequence -> (offset, length) of all pieces, by the plan."""
    ranks, out = defaultdict(int), defaultdict(list)
    for n in lengths:
        sequence, offset = plan.place(np.array([n]), np.array([ranks[n]]))
        ranks[n] += 1
        out[int(sequence[0])].append((int(offset[0]), n))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=120))
def test_a_plan_fits(lengths):
    plan = pattern_packing.plan(histogram(lengths, 24), 24)
    found = laid_out(plan, lengths)
    assert len(found) == plan.sequences
    for held in found.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 24
    # best fit decreasing needs at most 11/9 of the least number and one more
    assert plan.sequences <= -(-11 * max(least(lengths, 24), 0) // 9) + 1


def least(lengths, window):
    """A bound from below: pieces of more than half a window are in different ones."""
    return max(-(-sum(lengths) // window), sum(1 for n in lengths if 2 * n > window))


def test_patterns_fill_windows(rng):
    lengths = [min(200, int(rng.expovariate(1 / 60)) + 1) for _ in range(20_000)]
    h = histogram(lengths, 200)
    patterns = pattern_packing.enumerate_patterns(h, 200)
    assert ((patterns.lengths * patterns.times).sum(axis=1) == 200).all()
    counts = pattern_packing.fit(patterns, h, 200)
    assert (counts >= 0).all()
    # the fit reproduces most of the histogram, and the rounded counts keep within it
    n = np.arange(201)
    assert (n * abs(patterns.used(counts, 200) - h)).sum() < 0.05 * (n * h).sum()
    taken, left = pattern_packing.rounded(patterns, counts, h)
    assert (left >= 0).all()
    assert sum(w for _, w in taken) > 0.8 * sum(lengths) / 200
    alone = sum(w for w, _ in pattern_packing.best_fit(h, 200))
    assert pattern_packing.plan(h, 200).sequences <= 1.001 * alone


def test_least_squares_against_a_solvable_case():
    """Lengths that came from known patterns are explained by patterns."""
    h = np.zeros(33, np.int64)
    for a, b, c, n in ((20, 12, 0, 300), (16, 9, 7, 200), (30, 2, 0, 50)):
        for x in (a, b, c):
            h[x] += n if x else 0
    patterns = pattern_packing.enumerate_patterns(h, 32)
    counts = pattern_packing.fit(patterns, h, 32, rounds=20_000)
    assert np.allclose(patterns.used(counts, 32), h, atol=5)
    assert pattern_packing.plan(h, 32).sequences == 550


def test_cuts():
    assert pattern_packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert pattern_packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert pattern_packing.cut(4, 4) == [(0, 4)]
    assert pattern_packing.cut(1, 4) == [(0, 1)]


def test_query(spark, documents, odd_texts, tables):
    texts = [*odd_texts, *[f"some text {i} " * (i % 90) for i in range(300)], "word " * 2047, "word " * 4095, "<|endoftext|>"]
    folder = tables(documents=documents(*texts).repartition(5))
    got = QUERIES["op13_pattern_packing"](spark, folder).collect()
    library = Tokenizer.from_file(BYTE_BPE["path"]())
    ids = [np.array(e.ids + [0], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces, held = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        held[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(p) for d, p in pieces.items()} == {
        d: [(k, *c) for k, c in enumerate(pattern_packing.cut(len(x), 2048))] for d, x in enumerate(ids)
    }
    for sequence in held.values():
        at = 0
        for offset, n in sorted(sequence):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) <= -(-sum(map(len, ids)) // 2048) + 1


def test_nothing_repeated_rows_and_null_ids(spark, documents):
    assert pattern_packing.pack(documents("a").where(F.lit(False)), end_id=0, **BYTE_BPE).count() == 0
    rows = [(None, "b"), (None, "b"), (1, "x"), (1, "x"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pattern_packing.pack(docs, end_id=0, **BYTE_BPE).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 2), (0, 2), (1, 1), (1, 2), (1, 2)]
    assert sorted(r.offset for r in got) in ([0, 1, 3, 5, 7], [0, 2, 4, 6, 8])

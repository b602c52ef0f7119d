"""Token ids, token files and packing against the tokenizer itself."""

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listsieve.llm import packing, token_files, tokens
from listsieve.llm.queries import BYTE_BPE, QUERIES, WORD_BPE

PARTS = ["a", "B", "ab,", "x.!", "é", "ß", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "\r", "1", "9", "²", "Ⅷ", "!", "…",
         "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "日本", "​", "́", "\x1c", "\x85", "\xa0", "　", "ſ", "İ", "ﬁ", "🙂", "\x00", "Σ"]
BOTH = [BYTE_BPE, WORD_BPE]


@lru_cache
def library(path):
    """A tokenizer of the test's own, as the library loads it."""
    return Tokenizer.from_file(path)


def plain(kind, texts):
    return [e.ids for e in library(kind["path"]()).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", BOTH)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_ids_are_those_of_the_whole_text(kind, text):
    found = tokens.encoder(kind["path"](), kind["blank_led"]).encode([text, text])
    assert [np.frombuffer(b, tokens.ID).tolist() for b in found] == plain(kind, [text]) * 2


@pytest.mark.parametrize("kind", BOTH)
def test_special_strings_have_the_library_s_ids(kind):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>\n", "plain text", " a", "\na", ""]
    found = tokens.encoder(kind["path"](), kind["blank_led"]).encode(texts)
    assert [np.frombuffer(b, tokens.ID).tolist() for b in found] == plain(kind, texts)


@pytest.mark.parametrize("kind", BOTH)
def test_very_long_text_is_encoded_in_parts(kind, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 50)
    text = "Some words, in 2 lines.\n  And more of them " * 30 + "end"
    found = tokens.encoder(kind["path"](), kind["blank_led"]).encode([text, "", None])
    assert [np.frombuffer(b, tokens.ID).tolist() for b in found] == [*plain(kind, [text]), [], []]


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.integers(0, 70), st.integers(0, 70))
def test_bits_there_and_back(width, ids, a, b):
    ids = np.array([i & ((1 << width) - 1) for i in ids], np.uint32)
    start, stop = sorted((min(a, len(ids)), min(b, len(ids))))
    payload = token_files.pack(ids, width)
    assert len(payload) == -(-len(ids) // 8) * width
    assert token_files.unpack(payload, width, start, stop).tolist() == ids[start:stop].tolist()


def test_width_is_the_least():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def expected_ids(texts, kind, end):
    return [ids + [end] for ids in plain(kind, [t or "" for t in texts])]


def test_token_files(spark, documents, odd_texts, tables):
    folder = tables(documents=documents(*odd_texts).repartition(3))
    got = sorted(map(tuple, QUERIES["op1_token_files"](spark, folder).collect()))
    start, want = 0, []
    for i, ids in enumerate(expected_ids(odd_texts, BYTE_BPE, 2)):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, tokens.ID).tobytes())))
        start += len(ids)
    assert got == want


def test_range_of_a_store(spark, documents, monkeypatch):
    texts = [f"text number {i} of some" for i in range(40)]
    blocks = token_files.write(documents(*texts), "t", end_id=2, vocabulary=50_257, **BYTE_BPE)
    every = [i for ids in expected_ids(texts, BYTE_BPE, 2) for i in ids]
    assert token_files.read_range(blocks, 0, len(every)).tolist() == every
    assert token_files.read_range(blocks, 13, 57).tolist() == every[13:57]
    assert token_files.read_range(blocks, len(every), len(every) + 9).tolist() == []


def test_repeated_and_null_ids(spark):
    rows = [(None, "b"), (None, "a"), (1, "x"), (1, "x"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = token_files.write(docs, "t", end_id=2, vocabulary=50_257, **BYTE_BPE)
    got = sorted(token_files.documents(blocks).select("start", "doc_id", "n_tokens").collect())
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 2), (None, 2), (1, 1), (1, 2), (1, 2)]
    empty = token_files.write(docs.limit(0), "t", end_id=2, vocabulary=50_257, **BYTE_BPE)
    assert token_files.documents(empty).count() == 0


def check_windows(lengths, windows, window):
    held = defaultdict(list)
    for pieces in windows:
        total = sum(p[2] for p in pieces)
        assert 0 < total <= window
        for doc, start, length in pieces:
            assert length > 0
            held[doc].append((start, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(held[doc]):
            assert start == at
            at += n
        assert at == length


@given(st.lists(st.integers(0, 50), max_size=40))
def test_every_id_is_packed_once(lengths):
    windows = packing.best_fit(lengths, 16)
    check_windows(lengths, windows, 16)
    filled = packing.fill_gaps(windows, 16)
    check_windows(lengths, filled, 16)
    sizes = [sum(p[2] for p in w) for w in filled]
    assert all(s & (s - 1) == 0 for s in sizes)  # full (16), or a power of two: no padding
    assert sum(1 for s in sizes if s < 16) <= 5


@given(st.lists(st.integers(1, 16), min_size=1, max_size=40))
def test_best_fit_is_the_tightest(lengths):
    """Against a plain search over all open windows."""
    rooms, want = [], 0
    for n in sorted((x for x in lengths if x % 16), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(16 - n)
    want = len(rooms) + sum(1 for x in lengths if x == 16)
    assert len(packing.best_fit(lengths, 16)) == want


def test_packing(spark, documents, odd_texts, tables):
    folder = tables(documents=documents(*odd_texts))
    got = QUERIES["op3_packing"](spark, folder).collect()
    ids = [np.array(x, tokens.ID) for x in expected_ids(odd_texts, WORD_BPE, 1)]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for held, total in [(pieces[i], len(x)) for i, x in enumerate(ids)]:
        assert sum(n for _, n in held) == total
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:], strict=False))
    for held in sequences.values():
        held.sort()
        assert held[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False))
        total = sum(n for _, n in held)
        assert total == 2048 or total & (total - 1) == 0


def test_packing_of_nothing(spark, documents):
    assert packing.pack(documents("a").where(F.lit(False)), end_id=1, **WORD_BPE).count() == 0

"""Ranked search against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from listsieve.llm import ball_search, ball_tree
from listsieve.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(UP) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if t in c
            )
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=10, parts=3):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, n int").repartition(parts)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, ball_search.search(d, q, k).collect()), key=repr)


def some(rng, n, words=60, most=40):
    return [(i, " ".join(f"w{int(rng.expovariate(0.08)) % words}" for _ in range(rng.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize("rows,entries,leaf", [(8192, 1 << 20, 32), (50, 400, 4), (7, 1, 2)])
def test_against_plain_scoring(spark, rng, monkeypatch, rows, entries, leaf):
    monkeypatch.setattr(ball_search, "TREE_ROWS", rows)
    monkeypatch.setattr(ball_search, "TREE_ENTRIES", entries)
    monkeypatch.setattr(ball_tree, "LEAF", leaf)
    docs, items = some(rng, 600), some(rng, 20, most=12)
    assert run(spark, docs, items) == brute(docs, items)


def test_items_in_several_blocks(spark, rng, monkeypatch):
    monkeypatch.setattr(ball_search, "BLOCK_ITEMS", 3)
    docs, items = some(rng, 80), some(rng, 8, most=12)
    assert run(spark, docs, items, k=3) == brute(docs, items, k=3)
    monkeypatch.setattr(ball_search, "BLOCK_TERMS", 5)
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_texts_ties_repeats_and_null_ids(spark, odd_texts):
    docs = [*enumerate(odd_texts), (None, "same text"), (None, "SAME text!"), (3, "Word"), (3, "word"), (90, "word"), (4, "ÉÉ é 9x")]
    docs += [(100 + i, "tie tie tie") for i in range(25)]
    items = [(0, None), (1, ""), (2, "word WORD, word"), (2, "tie"), (None, "same é 9X now"), (5, "nowhere"), (6, "tie word tie")]
    assert run(spark, docs, items) == brute(docs, items)


def test_a_term_of_nearly_all_documents(spark):
    docs = [(i, "the" + (" rare" if i == 7 else "")) for i in range(3000)]
    items = [(0, "the"), (1, "the rare")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark, tables, documents):
    assert run(spark, [], [(1, "x")]) == []
    assert run(spark, [(1, "x")], []) == []
    assert run(spark, [(1, None), (2, "..")], [(1, "x")]) == []


def test_bounds_hold_and_prune():
    """Clusters far apart: bounds are above every score, and a search opens few leaves."""
    gen = np.random.default_rng(5)
    terms, values, starts = [], [], [0]
    for i in range(2000):
        own = 20 * (i % 50) + gen.choice(20, 8, replace=False)
        terms.append(np.sort(own))
        values.append(gen.integers(100_000, 200_000, 8))
        starts.append(starts[-1] + 8)
    asked = [20 * c + np.arange(6) for c in range(50)]
    queries = ball_tree.Queries(np.arange(0, 301, 6), np.concatenate(asked), gen.integers(1, 9000, 300))
    scale = np.sqrt(gen.integers(1, 9000, 1000).astype(float))
    tree = ball_tree.Tree(np.array(starts), np.concatenate(terms), np.concatenate(values), [(1, i) for i in range(2000)], scale, queries)
    dense = np.zeros((50, 1000), np.int64)
    for i, own in enumerate(asked):
        dense[i, own] = queries.weights[6 * i : 6 * i + 6]

    def walk(node):
        if not node.children:
            for i in range(50):
                scores = np.add.reduceat(node.values * dense[i][node.terms], node.starts[:-1])
                assert scores.max() <= node.bound[i]
            return node.bound, 1
        found = [walk(c) for c in node.children]
        return node.bound, sum(n for _, n in found)

    leaves = walk(tree.root)[1]
    for i in range(50):
        best = []
        tree.search(i, dense[i], best, 10)
        exact = np.array([(dense[i][t] * v).sum() for t, v in zip(terms, values, strict=True)])
        want = sorted((-int(s), 1, d) for d, s in enumerate(exact) if s > 0)[:10]
        assert best == want
    assert tree.opened < 0.5 * 50 * leaves


def test_query(spark, tables, documents):
    folder = tables(documents=documents("a b c", "b c d", None), benchmark=spark.createDataFrame([(7, "B d")], "item_id long, text string"))
    got = QUERIES["op11_ball_search"](spark, folder)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [1, 0]

"""The Jaccard join, its tree and the components against brute force."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listsieve.llm import components, count_tree, near_join
from listsieve.llm.queries import QUERIES


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    edges = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return {d: (len(sets[d]), root) for d, root in roots(edges, sets).items()}


@pytest.fixture
def copies(rng):
    """Texts of a few families with many edits: chains, near misses, fragments of others."""
    base = [[f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(rng.randint(1, 60))] for _ in range(12)]
    out = []
    for _ in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            kind = rng.randint(0, 2)
            if kind == 0 and words:
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 50)}"
            elif kind == 1 and len(words) > 1:
                words = words[rng.randint(0, 2) :]
            else:
                words = words + rng.choice(base)[: rng.randint(0, 9)]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("frequent", [True, False])
def test_join(spark, documents, copies, odd_texts, tables, monkeypatch, frequent):
    monkeypatch.setattr(near_join, "SEEN", 2 if frequent else 10**9)
    texts = copies + odd_texts
    folder = tables(documents=documents(*texts, first=5).repartition(3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_near_join"](spark, folder).collect()}
    assert got == brute(list(enumerate(texts, 5)))


@pytest.fixture
def template(rng):
    """Texts that share most of their words, too few for a link; some are copies of others."""
    shared = [f"t{i}" for i in range(160)]
    out = [" ".join(shared + [f"u{i}x{j}" for j in range(rng.randint(30, 90))]) for i in range(60)]
    return out + [f"{t} end" for t in out[::7]]


def test_large_groups_are_split(spark, documents, copies, template, tables, monkeypatch):
    tried, most = [], 6
    real = near_join.tree_pairs
    monkeypatch.setattr(near_join, "TREE_ROWS", most)
    monkeypatch.setattr(near_join, "tree_pairs", lambda groups: tried.append(groups) or real(groups))
    monkeypatch.setattr(near_join, "discard", lambda *tables: None)  # the groups are read again below
    texts = copies + template
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_near_join"](spark, tables(documents=documents(*texts))).collect()}
    assert got == brute(list(enumerate(texts)))
    by_token, by_block = (tried[0].groupBy(*keys).count().agg(F.max("count")).first()[0] for keys in (["token"], ["token", "block"]))
    assert by_token > 8 * most > by_block


def test_rows_of_split_groups_meet_once(spark, rng, monkeypatch):
    monkeypatch.setattr(near_join, "TREE_ROWS", 10)
    rows = [(token, node, node, rng.randint(1, 200)) for token, n in ((1, 150), (2, 10), (3, 11)) for node in range(n)]
    rows += [(4, i, i, n) for i, n in enumerate([3, 4] * 10)]
    got = near_join.blocks(spark.createDataFrame(rows, "token long, node long, component long, n long")).collect()
    held = defaultdict(list)
    for r in got:
        held[r.token, r.block].append(r)
    met = defaultdict(int)
    for (token, _), own in held.items():
        crossed = any(r.right for r in own)
        for x, y in itertools.combinations(own, 2):
            if not crossed or x.right != y.right:
                met[token, *sorted((x.node, y.node))] += 1
    assert set(met.values()) == {1}
    sizes = {(token, node): n for token, node, _, n in rows}
    for (token, x), (other, y) in itertools.combinations(sorted(sizes), 2):
        m, n = sorted((sizes[token, x], sizes[other, y]))
        if token == other and 4 * m >= 3 * n:
            assert (token, x, y) in met
    assert {r.block for r in got if r.token == 2} == {-1}


def test_null_and_repeated_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (7, text), (7, text), (3, text + " seven"), (None, "other"), (4, None)]
    got = near_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        [("None", 2, "7"), ("7", 2, "7"), ("7", 2, "7"), ("3", 3, "3"), ("None", 1, "None"), ("4", 0, "4")]
    )


def test_empty_table(documents):
    assert near_join.join(documents("a").where(F.lit(False))).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 150))
def test_tree_finds_what_bounds_allow(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 6, (5, 16))
    points = np.clip(base[rng.integers(0, 5, n)] + rng.integers(-1, 2, (n, 16)), 0, None)
    sizes, labels = points.sum(axis=1), rng.integers(0, 4, n)
    got = {tuple(sorted(p)) for a, b in count_tree.pairs(points, sizes, labels) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {
        (i, j)
        for i, j in itertools.combinations(range(n), 2)
        if labels[i] != labels[j] and 7 * np.minimum(points[i], points[j]).sum() >= 3 * (sizes[i] + sizes[j])
    }
    assert got == {p for p in got if p in want or 4 * min(sizes[list(p)]) < 3 * max(sizes[list(p)])}
    assert want <= got


def test_components(spark, rng):
    nodes = range(200)
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(120)] + [(i, i + 1) for i in range(150, 199)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    found = {r.node: r.component for r in got}
    assert len(got) == len(found)
    want = roots(edges, nodes)
    assert found == {n: want[n] for e in edges if e[0] != e[1] for n in e}


def test_tokens_of_alike_sets_meet(rng):
    order = near_join.Order(np.array(sorted(rng.sample(range(1000), 300)), np.uint64))
    hits = defaultdict(int)
    for _ in range(300):
        a = set(rng.sample(range(1000), rng.randint(4, 80)))
        b = (a - set(rng.sample(sorted(a), len(a) // 9))) | set(rng.sample(range(1000), len(a) // 9))
        if 100 * len(a & b) >= 75 * len(a | b):
            first = [set(order.first(np.array(sorted(s), np.uint64)).tolist()) for s in (a, b)]
            assert first[0] & first[1]
            hits["linked"] += 1
    assert hits["linked"] > 50


def test_counts_of_large_sets():
    """Counts beyond a byte take two; those beyond that are unbounded; all fit into one array."""
    one = np.arange(10, dtype=np.uint64)
    many, most = np.arange(300, dtype=np.uint64), np.arange(70_000, dtype=np.uint64)
    column = pa.array([near_join.fine_counts(s) for s in (one, many, most)], pa.binary())
    points = near_join.points_of(column)
    assert points.shape == (3, near_join.FINE)
    assert points[:2, 0].tolist() == [10, 300] and not points[:2, 1:].any()
    assert (points[2] == 1 << 20).all()

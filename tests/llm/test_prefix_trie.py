"""The prefix trie against a plain trie of rebuilt conversations."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from listsieve.llm import prefix_trie
from listsieve.llm.queries import QUERIES

SHAPE = "conv_id long, turn long, role string, text string, depth string, seq string, h1 string"


def rebuilt(rows):
    """conv_id -> its rebuilt turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    return out


def brute(rows):
    members = defaultdict(list)
    whole = rebuilt(rows)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def run(spark, tables, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SHAPE)
    got = QUERIES["op12_prefix_trie"](spark, tables(conversations=frame.repartition(3)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()))


def some(rng, convs):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, 14)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "é", "hello", "", "a b"]) if t < 11 else f"{c}"))
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_against_a_plain_trie(spark, tables, rng, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = some(rng, [*range(40), *range(1003, 1009), 57, 58])
    assert run(spark, tables, rows) == brute(rows)


def test_nulls_ties_and_repeats(spark, tables):
    rows = [
        (None, 1, "user", "of nobody"), (10, None, None, None), (10, None, "b", "x"), (10, 3, "a", "2"), (10, 3, "a", "1"),
        (10, 3, "a", "1"), (11, 1, "", ""), (11, 1, "b", "x"), (12, 5, "a", None), (13, 0, None, "z"), (14, 0, "user", "y" * 9),
    ]
    rows += [(15, t, "user", "same") for t in range(20)] + [(c, t, "user", "same") for c in (16, 17, 18, 20, 21) for t in range(20)]
    assert run(spark, tables, rows) == brute(rows)


def test_one_long_conversation_and_many_copies(spark, tables, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(700)]
    rows += [(c, t, "user", f"t{t % 7}") for c in range(100, 400, 5) for t in range(12)]
    assert run(spark, tables, rows) == brute(rows)


def test_only_rows_without_an_id(spark, tables):
    assert run(spark, tables, [(None, 1, "user", "x")]) == []


def test_long_lists_of_ends(spark):
    members = spark.range(30_000).selectExpr("id % 2 AS k1", "0L AS k2", "3L AS depth", "id * 7 AS conv_id")
    got = {r.k1: r.ends_sha256 for r in prefix_trie.joined_ends(members).collect()}
    want = {k: hashlib.sha256(",".join(str(7 * i) for i in range(k, 30_000, 2)).encode()).hexdigest() for k in (0, 1)}
    assert got == want

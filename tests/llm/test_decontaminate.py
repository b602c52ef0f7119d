"""Decontamination against a search for every window in every document."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from listsieve.llm import decontaminate
from listsieve.llm.queries import QUERIES

VOCABULARY = ["a", "B", "é", "c1", "x", "ß"]


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture
def texts(rng, odd_texts):
    return [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 40))) for _ in range(120)] + odd_texts


def items_of(rng, lengths):
    return [(i, "-".join(rng.choice(VOCABULARY) for _ in range(rng.choice(lengths)))) for i in range(30, 60)] + [(99, None)]


@pytest.mark.parametrize("lengths", [[0, 1, 2, 4, 6, 10, 11, 13], [9, 10, 11, 30], [0]])
def test_query(spark, documents, texts, rng, tables, lengths):
    items = items_of(rng, lengths) + [(7, texts[0]), (8, texts[0])]
    folder = tables(
        documents=documents(*texts).repartition(3),
        benchmark=spark.createDataFrame(items, "item_id long, text string").withColumn("source", F.lit("x")),
    )
    want = brute(texts, items)
    got = QUERIES["op7_decontaminate"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = want[r.doc_id]
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert tuple(r)[1:] == (n, hit, len(found), digest, hit > 0)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.match(documents("a").where(F.lit(False)), items).count() == 0
    assert [r.n_hit for r in decontaminate.match(documents("a b c"), items.where(F.lit(False))).collect()] == [0]


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c"), (1, "x a b c"), (1, "a b"), (1, "x a b c")]
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = decontaminate.match(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == [("1", 2, 0), ("1", 4, 3), ("1", 4, 3), ("None", 3, 3)]

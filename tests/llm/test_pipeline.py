"""The pipeline, stage by stage, against plain Python over small tables."""

import zlib
from collections import defaultdict

import corpus_pipeline as cp
import pytest
import test_decontaminate
import test_near_join
import test_secret_index
from pyspark.sql import functions as F

from listsieve.llm import language_codes
from listsieve.llm.queries import WORD_BPE
from listsieve.llm.tokens import encoder

ITEM = "one two three four five six seven eight nine ten eleven twelve"

@pytest.fixture
def folder(spark, rng, odd_texts, tables):
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += texts[:5] + [texts[7] + " and more"] + [f"before {ITEM} after", "1234 5678", 'x token = "abcdefghijklmnop1" y']
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(texts + odd_texts)]
    rows += [(None, texts[0], "en", "s", 1), (2, texts[2], "en", "s", len(texts[2])), (3, "another text", "en", "s", 12), (3, None, None, None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")
    return tables(documents=documents.withColumn("kept", F.lit("yes")).repartition(3), benchmark=benchmark)

def plain(rows):
    """Rows (doc_id, text, n_chars) that reach packing, of those that the language stage kept."""
    sets = [test_near_join.shingles(r[1]) for r in rows]
    edges = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    group = test_near_join.roots(edges, range(len(rows)))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[group[i]].append(r[0])
    rows = [r for i, r in enumerate(rows) if r[0] == min(least[group[i]], default=None)]
    rows = list({(r[0], r[1]): r for r in rows if r[0] is not None}.values()) + [r for r in rows if r[0] is None]
    hits = test_decontaminate.brute([r[1] for r in rows], [(1, ITEM)])
    rows = [r for r, (_, hit, _) in zip(rows, hits, strict=True) if not hit]
    out = []
    for doc_id, text, n in rows:
        clean, at = "", 0
        spans = test_secret_index.plain(text)
        for start, _, end, _ in spans:
            if start >= at:
                clean += text[at:start] + "[SECRET]"
            at = max(at, end)
        out.append((doc_id, clean + text[at:], len(clean + text[at:]) if spans else n))
    return out

def told(docs):
    """Rows that the language stage keeps: a letter, and no farther than the right ones of the
    held-out third."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    model = language_codes.fit(docs, F.coalesce(cp.remainder("doc_id", 3) != 1, F.lit(True)))
    rows = language_codes.identify(docs, model).collect()
    size = lambda t: (len(t) + 1).bit_length() - 1
    most = {}
    for r in rows:
        if held(r.doc_id) and r.lang == r.lang_pred:
            most[size(r.text)] = max(most.get(size(r.text), 0), r.distance)
    return [
        (r.doc_id, r.text, r.n_chars)
        for r in rows
        if any(c.isalpha() for c in r.text or "") and (size(r.text) not in most or r.distance <= 2 * max(v for k, v in most.items() if k >= size(r.text)))
    ]


def key(rows):
    return sorted(rows, key=str)

def test_stages(spark, folder, tmp_path):
    assert [name for name, _ in cp.STAGES] == ["language_codes", "near_join", "decontaminate", "secret_index", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = told(docs)
    want = plain(kept)
    for name, stage in cp.STAGES[:-1]:
        before = docs.columns
        if name == "near_join":
            assert key(map(tuple, docs.select("doc_id", "text", "n_chars").collect())) == key(kept)
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert docs.columns == before
    assert key(map(tuple, docs.select("doc_id", "text", "n_chars").collect())) == key(want)
    ids = encoder(WORD_BPE["path"](), False)
    sizes = sorted(len(x) // 4 + 1 for x in ids.plain([t for _, t, _ in want]))
    pieces = cp.run(spark, folder).collect()
    assert sorted(p.doc_tokens for p in pieces if p.start == 0) == sizes
    assert sum(p.length for p in pieces) == sum(sizes)

def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0

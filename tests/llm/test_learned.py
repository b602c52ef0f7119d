"""Learned operators: held-out accuracy, exact rules, and odd input."""

import math
import statistics
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from listsieve.llm import language_codes, quality_zstd, toxicity, url_filter
from listsieve.llm.queries import QUERIES, URL_RULES
from listsieve.llm.tables import labelled_sample

SYLLABLES = {
    "en": ["the", "ing", "and", "tion", "er", "ha", "on", "st"],
    "de": ["sch", "ein", "ung", "ver", "ä", "ich", "keit", "zu"],
    "es": ["ción", "que", "ñ", "ar", "os", "mente", "la", "rr"],
}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


def prose(rng, lang, n=None):
    return " ".join(word(rng, lang) for _ in range(n or rng.randint(4, 60)))


def held(doc_id, divisor, rest):
    return zlib.crc32(str(doc_id).encode()) % divisor == rest


@pytest.fixture
def corpus(spark, rng, tables, odd_texts):
    """Documents of three languages; some toxic (a hidden word), some junk."""
    docs, labels = [], []
    hide = {"i": "1", "o": "0"}
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        words = prose(rng, lang).split()
        toxic = int(rng.random() < 0.3)
        quality = int(rng.random() < 0.7)
        if toxic:
            bad = rng.choice(["zorgil", "vromit", "klopid"])
            if i % 3 == 0:
                bad = "".join(hide.get(c, c) for c in bad)
            words.insert(rng.randint(0, len(words)), " ".join(bad) if i % 7 == 0 else bad)
        if not quality:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        docs.append((i, " ".join(words), lang, "s", 0))
        if i % 4:
            labels.append((i, quality, toxic))
    docs += [(600 + i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(odd_texts)]
    labels += [(601, None, None), (602, 1, 0), (602, 1, 0), (None, 1, 1)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    folder = tables(
        documents=spark.createDataFrame(docs, shape).repartition(3),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
    return folder, docs, {d: (q, t) for d, q, t in labels if d is not None and q is not None and d < 600}


def test_language(spark, corpus):
    folder, docs, _ = corpus
    got = {r.doc_id: r for r in QUERIES["op4_language_codes"](spark, folder).collect()}
    assert len(got) == len(docs)
    right = []
    for doc_id, text, lang, *_ in docs:
        r = got[doc_id]
        assert r.held_out == held(doc_id, 3, 1)
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out and doc_id < 600:
            right.append(r.lang_pred == lang)
    assert sum(right) / len(right) > 0.98


def test_codewords_part_all_languages():
    for k in (2, 3, 5, 7, 8, 40):
        codes = language_codes.codewords(k)
        assert len(np.unique(codes, axis=0)) == k
        assert (np.abs(codes.sum(axis=0)) < k).all()


def test_language_with_little_to_learn(documents):
    one = language_codes.fit(documents("a b", "c d"), F.lit(True))
    assert {r.lang_pred for r in language_codes.identify(documents("x", "1", None), one).collect()} == {"en", "und"}
    none = language_codes.fit(documents("a b"), F.lit(False))
    assert {r.lang_pred for r in language_codes.identify(documents("x", "1", None), none).collect()} == {"und"}
    assert language_codes.identify(documents("x").where(F.lit(False)), one).count() == 0


def test_toxicity(spark, corpus):
    folder, docs, labels = corpus
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, folder).collect()}
    assert len(got) == len(docs)
    right = [got[d].predicted == t for d, (_, t) in labels.items() if held(d, 3, 1)]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(r.doc_id, 3, 1) for r in got.values())


@pytest.fixture(scope="module")
def chances(spark):
    words = "idiot moron stupid clown trash loser the and of that with disgusting pathetic worthless is it on"
    docs = spark.createDataFrame([(f"{words} {words}",)] * 20, "text string")
    return toxicity.log_chances(toxicity.trigram_counts(docs))


@pytest.mark.parametrize(
    ("written", "meant"),
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("idiiiiot", "idiot"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"),
     ("$tup1d", "stupid"), ("tr4sh!!", "trash"), ("L000SER", "loser"), ("d1sgust1ng", "disgusting"), ("p4th3t1c", "pathetic")],
)
def test_restoring(chances, written, meant):
    found = toxicity.Reader(chances).words(f"the {written} of")[1]
    assert {toxicity.collapsed(w) for w in found} == {toxicity.collapsed(meant)}


@pytest.mark.parametrize(
    ("written", "meant"),
    [("a$$", "ass"), ("cla5$", "class"), ("id107", "idiot"), ("1 d 1 0 t", "idiot"), ("i.d.1.0.t", "idiot"), ("i  d  i  o  t", "idiot"),
     ("ii dd ii oo tt", "idiot"), ("i_d_1_0_t", "idiot"), ("m 0  r - 0 . n", "moron"), ("i*d*i*o*t", "idiot"),
     ("tra5h", "trash"), ("worthle$$", "worthless")],
)
def test_restoring_signs_at_the_end_and_apart(chances, written, meant):
    found = toxicity.Reader(chances).words(f"the {written} of")[1]
    assert {toxicity.collapsed(w) for w in found} == {toxicity.collapsed(meant)}


def test_punctuation_around_letters_apart(chances):
    assert "idiot" in toxicity.Reader(chances).words("the (i d i o t!) of")[1]


def test_stretches_are_found_in_linear_time():
    for text in ("!" * 100_000, "x" * 100_000, "1 " * 50_000, "a" + " " * 100_000 + "bc", "* " * 50_000, "a_" * 50_000):
        start = time.process_time()
        sum(map(len, toxicity.stretches(text)))
        assert time.process_time() - start < 2


@pytest.mark.parametrize(
    ("written", "meant"),
    [("i d i o t i d i o t", {"idiot"}), (" ".join("disgustingpatheticworthlessidiot"), {"disgusting", "pathetic", "worthless", "idiot"}),
     ("id" + "i" * 100 + "ot", {"idiot"}), (" ".join("idiot" * 2000), {"idiot"})],
)
def test_long_stretches_are_read_word_by_word(chances, written, meant):
    assert toxicity.Reader(chances).words(f"the {written} of")[1] == meant


def test_score_of_words_within_a_long_stretch(chances):
    scorer = toxicity.Scorer(toxicity.Model(chances, {"idiot": 2.0, "moron": 1.0}, 0.0))
    assert scorer.margin("the " + " ".join("patheticworthlessidiotdisgustingmoron") + " of") == 3.0


def test_plain_words_are_not_decoded():
    text = "Plain words, 1234 5678 and the&&& rest: a b is-it all."
    assert not list(toxicity.stretches(text)) and not toxicity.REPEATED.search(text)


def test_counts_are_those_of_all_documents(spark):
    docs = spark.createDataFrame([("ab",), ("ab ab",), (None,), ("",)], "text string")
    table = toxicity.trigram_counts(docs)
    a, b = toxicity._CODE["a"], toxicity._CODE["b"]
    assert (table[0, 0, a], table[0, a, b], table[a, b, 0]) == (2, 3, 3)


def test_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents("a b", None)
    toxic = toxicity.fit(docs, labels, F.lit(True))
    assert [r.score for r in toxicity.score(docs, toxic).collect()] == [pytest.approx(0.5)] * 2
    quality = quality_zstd.fit(docs, labels, F.lit(True))
    assert [r.score for r in quality_zstd.score(docs, quality).collect()] == [pytest.approx(0.5)] * 2


def test_quality(spark, corpus):
    folder, docs, labels = corpus
    got = {r.doc_id: r for r in QUERIES["op10_quality_zstd"](spark, folder).collect()}
    assert len(got) == len(docs)
    right = [got[d].predicted == q for d, (q, _) in labels.items() if held(d, 5, 0)]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id, 5, 0) for r in got.values())


def test_quality_against_plain_compression(spark, corpus, documents, odd_texts):
    """Each text alone: packed block by block with either dictionary, the median of the differences."""
    folder, docs, labels = corpus
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_zstd.fit(frame, spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))

    def packed(dictionary, block):
        known = zstandard.ZstdCompressionDict(dictionary)
        known.precompute_compress(level=3)
        with_it = zstandard.ZstdCompressor(
            level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        return max(len(with_it.compress(block)) - len(with_it.compress(b"")), 1)

    def plain(text):
        data = (text or "").encode()
        count = math.ceil(len(data) / 128)
        size = math.ceil(len(data) / count) if count else 1
        cut = [data[i : i + size] for i in range(0, len(data), size)]
        middle = statistics.median([(packed(model.bad, b) - packed(model.good, b)) / len(b) for b in cut] or [0])
        return 1 / (1 + math.exp(-(middle * model.slope + model.offset)))

    texts = [*odd_texts[:7], *odd_texts[8:], *(d[1] for d in docs[:25])]
    got = {r.doc_id: r.score for r in quality_zstd.score(documents(*texts).unionByName(documents(*texts)), model).collect()}
    assert [got[i] for i in range(len(texts))] == [pytest.approx(plain(t), abs=1e-9) for t in texts]
    assert quality_zstd.score(documents(), model).count() == 0


def test_labelled_sample_of_repeated_ids_and_long_texts(spark):
    """One text of an id and label, however often the id repeats; a byte bound on what is learnt."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), *[(1, "b")] * 50, (2, "c" * 900), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r._id, r.text, r.label) for r in got) == [(1, "a", 1), (2, "c" * 900, 1), (4, "d", 0)]
    assert quality_zstd.fit(docs, labels, F.lit(True), most=800).good == b"a"


def split(url):
    """Host and path as the contract words them."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


URLS = [None, "", "no scheme", "http://", "://", "http://COM/x", "http://a.com", "http://a.com/", "https://example.com/en/1",
        "https://www.Example.com/en/1", "https://x.www.example.com/en/", "https://notexample.com/en/1", "http://a.net/es/1?x#y",
        "http://a.net/fr", "http://net/fr/", "ftp://u@h:8/p?q://z", "http://é.net/ES/", "http://a?b/c", "http://a#b/c://d",
        "x://y://z/w", "http://win-casino.example.org/", "http://library.example.org/", "http://a.com/" + "p" * 5000]


def test_urls(spark, tables):
    folder = tables(pages=spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit(1)))
    got = {r.page_id: r for r in QUERIES["op5_url_filter"](spark, folder).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = split(url)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")
    assert got[URLS.index("http://win-casino.example.org/")].verdict == "block"
    assert got[URLS.index("http://library.example.org/")].verdict == "allow"


def test_url_model_on_names_it_has_not_seen():
    weights = url_filter.fit(url_filter.seed())
    bad = ["casino-palace.example.org", "m.mega-pills.example.net", "adult-clips.example.com", "www.spam-mill.example.org"]
    good = ["gardening.example.org", "www.physics-notes.example.net", "evening-news.example.com", "m.theory.example.org"]
    z = url_filter.margins(weights, bad + good, ["/"] * 8)
    assert (z > 0).tolist() == [True] * 4 + [False] * 4
    with pytest.raises(ValueError):
        url_filter.fit([])


def plain_grams(text, order, buckets, keep=str.isalpha):
    """Buckets of the n-grams of one text, by Python integers."""
    points = [0, *(ord(c) if keep(c) else 0 for c in text.lower()), 0]
    out = []
    for i in range(len(points) - order + 1):
        h = order
        for p in points[i : i + order]:
            h = (h * 0x100000001B3 + p) % 2**64
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 % 2**64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB % 2**64
        out.append((h ^ h >> 31) % buckets)
    return out


def test_texts_of_no_learnt_language_are_far(spark, rng):
    docs = spark.createDataFrame([(i, prose(rng, lang), lang) for i in range(200) for lang in SYLLABLES], "doc_id long, text string, lang string")
    model = language_codes.fit(docs, F.col("doc_id") % 3 != 1)
    held = docs.where("doc_id % 3 = 1")
    limits = language_codes.distance_limits(held, model)
    found = language_codes.identify(held, model).where("lang_pred = lang")
    assert found.where(~language_codes.in_limits(limits)).count() == 0
    assert language_codes.distance_limits(held.limit(0), model) == {}
    # each class's limit by hand
    rows = found.select("text", "distance").collect()
    by_size = {}
    for r in rows:
        size = (len(r.text) + 1).bit_length() - 1
        by_size[size] = max(by_size.get(size, 0), r.distance)
    assert limits == {k: pytest.approx(2 * max(v for j, v in by_size.items() if j >= k)) for k in by_size}
    noise = spark.createDataFrame([(" ".join("".join(rng.choices("qxzvjwkyfp", k=7)) for _ in range(30)),) for _ in range(20)], "text string")
    assert language_codes.identify(noise, model).where(language_codes.in_limits(limits)).count() == 0


TINY = ["a", "no", "x", "", "ab", "sch", "the", "http", "1", "ñ", "que la", "ein", "İ"]


def test_language_against_plain_python(rng):
    """Margins, loss and codeword of one text at a time, by a loop."""
    languages = ("de", "en", "es")
    table = np.zeros((3, language_codes.BUCKETS))
    for i, lang in enumerate(languages):
        for order in language_codes.ORDERS:
            for b in plain_grams(prose(rng, lang, 400), order, language_codes.BUCKETS):
                table[i, b] += 1
    model = language_codes.derive(languages, table)
    texts = [*TINY, *(prose(rng, lang) for lang in SYLLABLES for _ in range(10))]
    best, score, _, distance = language_codes.decode(language_codes.margins_of(texts, model), model)
    for text, found, sure, far in zip(texts, best, score, distance, strict=True):
        grams = [b for order in language_codes.ORDERS for b in plain_grams(text, order, language_codes.BUCKETS)]
        margin = sum(model.weights[b].astype(float) for b in grams) / len(grams)
        loss = [
            sum(w * np.log1p(np.exp(-4.0 * m * c)) for m, c, w in zip(margin, code, model.bit_weights, strict=True))
            for code in model.codes
        ]
        likely = [np.exp(-4.0 * (x - min(loss))) for x in loss]
        assert found == loss.index(min(loss)) and far == pytest.approx(min(loss))
        assert sure == pytest.approx(max(likely) / sum(likely))


def test_answers_do_not_depend_on_other_rows(rng):
    languages = tuple(sorted(SYLLABLES))
    table = np.array([np.bincount(sum((plain_grams(prose(rng, x, 300), o, language_codes.BUCKETS) for o in (1, 2, 3)), []), minlength=language_codes.BUCKETS) for x in languages])
    model = language_codes.derive(languages, table.astype(float))
    weights = url_filter.fit(url_filter.seed())
    texts = [*TINY, *(prose(rng, lang, rng.randint(1, 4)) for lang in SYLLABLES for _ in range(6))]
    alone = [language_codes.margins_of([t], model)[0] for t in texts]
    hosts = ["a.io", "sun.org", "", "x", "ads.net", "poker.example.org", "b.de"]
    single = [url_filter.margins(weights, [h], ["/en/1"])[0] for h in hosts]
    for _ in range(20):
        order = rng.sample(range(len(texts)), rng.randint(1, len(texts)))
        found = language_codes.margins_of([texts[i] for i in order], model)
        assert np.allclose(found, [alone[i] for i in order], rtol=1e-12, atol=1e-12)
        order = rng.sample(range(len(hosts)), rng.randint(1, len(hosts)))
        found = url_filter.margins(weights, [hosts[i] for i in order], ["/en/1"] * len(order))
        assert np.allclose(found, [single[i] for i in order], rtol=1e-12, atol=1e-12)


def test_urls_empty_and_repeated(spark, tables):
    pages = spark.createDataFrame([(1, "http://poker.example.org/"), (1, "http://poker.example.org/"), (None, None)], "page_id long, url string")
    got = QUERIES["op5_url_filter"](spark, tables(pages=pages)).collect()
    assert len(got) == 3 and len({(r.host, r.verdict, r.score) for r in got if r.page_id}) == 1
    assert QUERIES["op5_url_filter"](spark, tables(pages=pages.limit(0))).count() == 0

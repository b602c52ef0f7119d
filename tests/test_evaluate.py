import random
import re

import pytest
from helpers import ads, values
from pyspark.sql import Observation
from pyspark.sql import functions as F

from listsieve import Bonus, Geography, Keyword, Profile
from listsieve.functions.language import language_excluded
from listsieve.functions.lexicon import DEFAULT_LEXICON
from listsieve.operators.evaluate import (
    evaluate,
    language_votes,
    matched,
    purge,
    reject_funnel,
    run_metrics,
    without_rejected,
)
from listsieve.operators.merge import merge_fresh
from listsieve.operators.score_terms import score_token_join
from listsieve.plans import queries

PROFILE = Profile(
    keywords=(Keyword("rust", 4), Keyword("tokio", 5), Keyword("c++", 3), Keyword("bash", 0), Keyword("cobol", -3)),
    min_score=4,
    title_boost=("rust", "backend"),
    exclude=("junior", "designer"),
    exclude_companies=("Evil corp",),
    require_any=("rust", "tokio", "c++", "cobol"),
    core_title_terms=("rust", "c++"),
    adjacent_titles=("java",),
    languages=("en", "de"),
    bonuses=(Bonus(("b2b", "freelance"), 1, "freelance-friendly"), Bonus(())),
    geography=Geography(
        "portugal", "eu-remote", True,
        ("portugal", "lisbon"), ("europe", "anywhere"), ("usa", "mexico", "canada"),
    ),
)


def run(spark, profile=PROFILE, **ad):
    row = evaluate(ads(spark, ad), profile).first()
    return row["keep"], row["reject_reason"], row["score"], row["reasons"], row["fit"]


@pytest.mark.parametrize(
    "ad, expected",
    [
        (dict(title="Rust Dev", location="Lisbon, Portugal", description="Tokio"), (True, None, 11, ["rust", "tokio"], "portugal (portugal)")),
        (dict(title="Backend Dev", location="Europe", description="rust, b2b"), (True, None, 7, ["rust", "freelance-friendly"], "eu-remote (europe)")),
        (dict(title="Rust Dev", description="Tokio"), (True, None, 11, ["rust", "tokio"], "eu-remote (unverified)")),
        (dict(title="Rust Dev", location="USA only"), (False, "geography", 0, [], "")),
        (dict(title="Rust Dev (Mexico)", description="anywhere"), (False, "geography", 0, [], "")),
        (dict(title="Rust Dev", description="in the USA or Europe"), (True, None, 6, ["rust"], "eu-remote")),
        (dict(title="Rust Dev", description="from Lisbon, no usa"), (True, None, 6, ["rust"], "portugal")),
        (dict(title="Rust Dev", description="Canada"), (False, "geography", 0, [], "")),
        (dict(title="Rust Dev", company="The EVIL CORP ltd"), (False, "company", 0, [], "")),
        (dict(title="Junior Rust Dev"), (False, "title", 0, [], "")),
        (dict(title="Java Dev", description="some rust"), (False, "focus", 0, [], "")),
        (dict(title="Java/Rust Dev", description=""), (True, None, 6, ["rust"], "eu-remote (unverified)")),
        (dict(title="Engineer", description="trusty"), (False, "focus", 0, [], "")),
        (dict(title="Engineer", tags=["C++", "Bash"]), (True, None, 4, ["c++", "bash"], "eu-remote (unverified)")),
        (dict(title="Engineer", tags=["C++"]), (False, "score", 3, ["c++"], "eu-remote (unverified)")),
        (dict(title="Rust Engineer", tags=["cobol"]), (False, "score", 3, ["rust", "cobol"], "eu-remote (unverified)")),
    ],
)
def test_cascade(spark, ad, expected):
    assert run(spark, **ad) == expected


def test_geography_switches(spark):
    strict = PROFILE.but(geography=Geography(keep_unverified=False, local_markers=("lisbon",)))
    assert run(spark, strict, title="Rust Dev")[:2] == (False, "geography")
    off = PROFILE.but(geography=Geography(keep_unverified=False))
    assert run(spark, off, title="Rust Dev", location="USA") == (True, None, 6, ["rust"], "")
    # Markers are taken as written, so one in upper case never matches.
    upper = PROFILE.but(geography=Geography(local_markers=("Lisbon",)))
    assert run(spark, upper, title="Rust Dev", location="Lisbon")[4] == "remote (unverified)"


def test_checks(spark):
    with pytest.raises(ValueError, match="keywords"):
        evaluate(ads(spark, {}), PROFILE.but(keywords=()))
    with pytest.raises(ValueError, match="tlh"):
        evaluate(ads(spark, {}), PROFILE.but(languages=("en", "tlh")))
    assert len(DEFAULT_LEXICON.supported) == 14


TEXTS = {
    "We look for you: work with the team, with skills and experience": ([], ["pl"]),
    "Wir suchen dich und deine Erfahrung. Die Aufgaben: das und der": ([], ["pl"]),
    "Programista — oferujemy umowa, wymagania: znajomość, doświadczenie": (["pl"], []),
    "Starszy programista Rust B2B": (["pl"], []),
    "Търсим програмист за екипа ни в София, опит с Rust": (["bg"], []),
    "Développeur: nous recherchons pour notre équipe, expérience et maîtrise": (["fr"], []),
    "Rust Tokio Docker Kubernetes": ([], []),
    "123 - 456": ([], []),
    "": ([], []),
}


@pytest.mark.parametrize("text", TEXTS)
def test_language(spark, text):
    """Foreign to readers of English and German or not; known to its own readers."""
    foreign_to, _ = TEXTS[text]
    frame = spark.createDataFrame([("", text)], "title string, description string")
    got = frame.select(
        language_excluded("title", "description", ["en", "de"]).alias("en_de"),
        language_excluded("title", "description", foreign_to or ["en", "de"]).alias("own"),
        language_excluded("title", "description", []).alias("all"),
    ).first()
    assert tuple(got) == (bool(foreign_to), False, False)


def test_language_edges(spark):
    def excluded(title, description="", keep=("en",)):
        frame = spark.createDataFrame([(title, description)], "title string, description string")
        return values(frame, language_excluded("title", "description", list(keep)))[0]

    # A foreign title is not rescued by Latin words in the text.
    assert excluded("ПРОГРАМИСТ RUST", "React Native MySQL Docker Linux " * 5)
    # Exactly 15 of 100 letters are kept, one more is not.
    assert not excluded("a" * 85 + "ж" * 15)
    assert excluded("a" * 84 + "ж" * 16)
    # English is foreign when only Polish is read.
    assert excluded("you will work with our team and the skills", keep=["pl"])
    # Diacritics add two votes once, but are no verdict alone.
    assert not excluded("ąćęłńśźż ąćęł", keep=["en"])
    assert excluded("praca ąćęłńśźż", keep=["en"])


def test_votes_share_boundaries(spark):
    frame = spark.createDataFrame([("the and you",), ("the  and  you",), ("the " * 100,)], "t string")
    votes = language_votes(frame, "t", ["en"])
    assert values(votes, "kept_votes") == [2, 3, 25]


def test_metrics_and_funnel(spark):
    rows = [
        dict(source="a", title="Rust Dev"),
        dict(source="a", title="Junior Rust"),
        dict(source="b", title="Engineer", tags=["C++"]),
    ]
    done = evaluate(ads(spark, *rows), PROFILE)
    assert sorted(values(run_metrics(done), "source", "fetched", "matched")) == [("a", 2, 1), ("b", 1, 0)]
    funnel = dict(((s, o), n) for s, o, n in values(reject_funnel(done), "source", "outcome", "ads"))
    assert funnel == {
        ("a", "kept"): 1, ("a", "title"): 1, ("b", "score"): 1, ("a", "*"): 2, ("b", "*"): 1, ("*", "*"): 3,
    }


def test_purge_keeps_tracked_rows_out_of_focus_only(spark):
    state = ads(
        spark,
        dict(title="Rust Dev"),
        dict(title="Baker", source="applied"),
        dict(title="Baker"),
        dict(title="Rust Dev", company="evil corp", source="applied"),
        dict(title="Starszy programista", source="applied"),
        dict(title="Junior Rust Dev", location="USA"),  # title and place are not re-applied
    ).withColumn("status", F.col("source"))
    seen = Observation("purge")
    kept = purge(state, PROFILE, observation=seen)
    assert sorted(values(kept, "seq")) == [0, 1, 5]
    assert seen.get == {"removed": 3}


def test_token_join_scores_like_the_unrolled_form(spark):
    profile = PROFILE.but(title_boost=(), bonuses=(), languages=(), require_any=("rust", "c", "the"), adjacent_titles=())
    rows = [
        dict(title="Rust, C++ and bash"),
        dict(title="Tokio", description="rust-c++ cobol"),
        dict(title="the C+ bashful rusty"),
        dict(title="rust rust bash bash"),
    ]
    batch = ads(spark, *rows)
    terms = spark.createDataFrame(
        [(i, k.term, k.weight) for i, k in enumerate(PROFILE.keywords)], "ord int, term string, weight int"
    )
    hay = batch.select("seq", F.concat_ws("\n", "title", F.concat_ws(" ", "tags"), "description").alias("text"))
    unrolled = evaluate(batch, profile.but(geography=Geography(), min_score=-100))
    expected = {s: (n, r) for s, n, r in values(unrolled, "seq", "score", "reasons") if r}
    for limit in (100, 0):  # broadcast, and salted shuffle
        got = score_token_join(hay, terms, "seq", broadcast_terms=limit)
        assert {s: (n, r) for s, n, r in values(got, "seq", "score", "reasons")} == expected


def test_terms_of_all_kinds_against_their_regex(spark):
    """Marks at either end, several words, letters beyond ASCII, neighbours that forbid a match."""
    rng = random.Random(4)
    names = ["c++", ".net", "node.js", "a b", "a", "b", "ß", "日本", "++", "a b a", "c", ".", "é", "b,", " a", "a.", "net", "(a b)", "日"]
    parts = ["a", "b", " ", "  ", "c", "+", "++", ".", "net", "node", "js", "ß", "日", "本", "é", ",", "(", ")", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(400)] + ["c++", "a c++", "c++ a", ".net", "asp.net", "日本"]
    ads = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = spark.createDataFrame([(i, t, i + 1) for i, t in enumerate(names)], "ord int, term string, weight int")
    for limit in (1000, 1):
        got = {r.id: (r.score, r.reasons) for r in score_token_join(ads, terms, broadcast_terms=limit).collect()}
        want = {}
        for i, text in enumerate(texts):
            hits = [k for k, t in enumerate(names) if re.search("(^|[^a-z0-9])" + re.escape(t) + r"($|[^a-z0-9])", text)]
            if hits:
                want[i] = (sum(k + 1 for k in hits), [names[k] for k in hits])
        assert got == want


def test_source_metrics_evaluate_each_ad_once(spark, tmp_path, monkeypatch):
    rows = [
        (i, ["Go only les, the, die", "nicht", "the thea only attion und europe", None][i % 4] + f". Text {i}" if i % 4 < 3 else None, "en", f"s{i % 3}")
        for i in range(240)
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"R{i}") for i in range(3)], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    plain = evaluate(queries.fx.ads(spark, tmp_path), queries.fx.PROFILE)
    fresh = merge_fresh(queries.fx.state(spark, tmp_path, before_batch=True), matched(plain), queries.fx.NOW, order="seq")
    expected = sorted(run_metrics(plain, fresh).collect())
    assert any(r.matched > r.new > 0 for r in expected)

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(queries, "evaluate", lambda ads, profile: evaluate(ads.withColumn("description", counted("description")), profile))
    assert sorted(queries.source_metrics(spark, tmp_path).collect()) == expected
    assert seen.value == len(rows)


def test_rejected_rows_keep_source_and_verdict(spark):
    shape = "source string, description string, keep boolean, reject_reason string"
    done = spark.createDataFrame([("a", "x", True, None), ("b", "y", False, "score"), (None, None, False, "title")], shape)
    got = values(without_rejected(done), *done.columns)
    assert got == [("a", "x", True, None), ("b", None, False, "score"), (None, None, False, "title")]

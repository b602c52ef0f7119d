import datetime as dt

import pytest
from helpers import one, values
from pyspark.sql import functions as F

from listsieve.functions import dates, text, urls


@pytest.mark.parametrize(
    "haystack, term, found",
    [
        ("We like Node.js a lot", "node.js", True),
        ("We like nodexjs a lot", "node.js", False),
        ("c++ and c", "c++", True),
        ("abc++", "c++", False),
        (".NET shop", ".net", True),
        ("phpectomy", "php", False),
        ("PHP", "php", True),
        ("(php)", "php", True),
        ("éphp", "php", True),  # a letter beyond ASCII is a boundary
        ("php8", "php", False),
        ("Köln jobs", "KÖLN", True),
        ("ſymfony", "symfony", True),
        ("a\\Eb", "\\E", False),
        ("x \\E y", "\\E", True),
    ],
)
def test_word_match(spark, haystack, term, found):
    assert one(spark, text.word_match("t", term), t=haystack) is found


def test_any_match_of_many_terms_equals_single_ones(spark):
    terms = [f"w{i}" for i in range(text.PREFILTER_TERMS + 5)]
    rows = spark.createDataFrame([("a w3 b",), ("w99",), ("xw3",), ("w52.",)], "t string")
    assert values(rows, text.any_match(text.fold("t"), terms)) == [True, False, False, True]


@pytest.mark.parametrize(
    "html, plain",
    [
        ("<p>One</p>two<br>three<br/>four", "One two three four"),
        ("a &amp;lt; b", "a &lt; b"),
        ("&eacute;t&eacute; &#8364; &amp; &lt;x&gt;", "été € & <x>"),
        ("&amp is &notit;", "& is ¬it;"),
        ("a   b\n\n", "a b"),
        ("<script>var x</script>y", "var x y"),
        ("", ""),
    ],
)
def test_strip_html(spark, html, plain):
    assert one(spark, text.strip_html("t"), t=html) == plain


def test_truncate_counts_bytes_and_keeps_characters_whole(spark):
    assert one(spark, text.truncate("t", 5), t="abcde") == "abcde"
    assert one(spark, text.truncate("t", 5), t="abcdef") == "abcde…"
    assert one(spark, text.truncate("t", 5), t="abcdé") == "abcd…"
    assert one(spark, text.truncate("t", 5), t="ab🔍cd") == "ab…"
    assert one(spark, text.truncate("t", 6), t="ab🔍cd") == "ab🔍…"


@pytest.mark.parametrize(
    "url, normal",
    [
        ("https://example.com/job/1?gh_jid=7&srsltid=AbC123", "https://example.com/job/1?gh_jid=7"),
        ("HTTPS://Ex.com/a?B=2&a=1&UTM_Source=x&ref=1#frag", "https://Ex.com/a?B=2&a=1"),
        ("https://e.com/?a=2&a=1&b", "https://e.com/?a=2&a=1&b="),
        ("https://e.com/p?", "https://e.com/p?"),
        ("https://e.com/p?utm_a=1", "https://e.com/p"),
        ("https://e.com/p", "https://e.com/p"),
        ("https://e.com/%zz?utm_a=1", "https://e.com/%zz?utm_a=1"),
        ("https://e.com/a?x=%zz&y=1;2&z=1", "https://e.com/a?z=1"),
        ("https://e.com/a?x=a+b&y=%7e*", "https://e.com/a?x=a+b&y=~%2A"),
        ("https://e.com/é b?q=é", "https://e.com/%C3%A9%20b?q=%C3%A9"),
        ("mailto:x@y.z?subject=a%20b", "mailto:x@y.z?subject=a+b"),
        ("https://e.com:8a/x?ref=2", "https://e.com:8a/x?ref=2"),
        ("https://e com/x?ref=2", "https://e com/x?ref=2"),
        ("https://[::1]:80/x?ref=2", "https://[::1]:80/x"),
        ("1foo:bar?ref=1", "1foo:bar?ref=1"),
        ("", ""),
    ],
)
def test_normalize_url(spark, url, normal):
    assert one(spark, urls.normalize_url("u"), u=url) == normal


def test_normalize_url_is_idempotent_and_survives_long_input(spark):
    long = "https://e.com/" + "a%20" * 50_000 + "?x=1&utm_b=2"
    assert one(spark, urls.normalize_url("u"), u=long) == long.replace("&utm_b=2", "")


def test_hosts_and_paths(spark):
    assert one(spark, urls.bare_host("u"), u="https://u@www.Acme.test:80/x") == "Acme.test"
    assert one(spark, urls.host("u"), u="//[::1]:8/x") == "::1"
    assert one(spark, urls.host("u"), u="no host") == ""
    for url, segment in {
        "https://b.test/company/jobs/php/": "php",
        "https://b.test/remote/golang": "golang",
        "https://b.test/offers/all/go?w": "go",
        "https://b.test": "",
    }.items():
        assert one(spark, urls.last_path_segment("u"), u=url) == segment
    assert one(spark, urls.absolute_url("u", "https://b.test"), u="/j/1") == "https://b.test/j/1"
    mirrored = urls.rewrite_mirror("u", "https://a.test/", "https://b.test/")
    assert one(spark, mirrored, u="https://a.test/https://a.test/") == "https://b.test/https://a.test/"


def test_identity(spark):
    assert one(spark, urls.ad_id("s", "u"), s="test", u="https://e.com/1") == (
        __import__("hashlib").sha1(b"test|https://e.com/1").hexdigest()[:16]
    )
    same = [("Acme, Inc.", "Go  Dev!"), ("acme inc", "go dev")]
    keys = values(spark.createDataFrame(same, "c string, t string"), urls.content_key("c", "t"))
    assert keys[0] == keys[1]
    other = [("Я", "А"), ("Б", "В")]
    frame = spark.createDataFrame(other, "c string, t string")
    assert len(set(values(frame, urls.content_key("c", "t")))) == 1
    assert len(set(values(frame, urls.content_key("c", "t", unicode_keys=True)))) == 2


def test_dates(spark):
    utc = dt.datetime

    def get(column, value):
        return one(spark, column(F.col("t")), t=value)

    assert get(dates.parse_rfc3339, "2026-01-03T04:05:06+02:00") == utc(2026, 1, 3, 2, 5, 6)
    assert get(dates.parse_rfc3339, "2026-01-03T04:05:06.5Z") == utc(2026, 1, 3, 4, 5, 6, 500000)
    assert get(dates.parse_rfc3339, "2026-01-03T04:05:06") is None
    assert get(dates.parse_zoneless, "2026-01-03T04:05:06") == utc(2026, 1, 3, 4, 5, 6)
    assert get(dates.parse_zoneless, "2026-13-03T04:05:06") is None
    assert get(dates.parse_rfc1123z, "Mon, 02 Jan 2006 15:04:05 -0700") == utc(2006, 1, 2, 22, 4, 5)
    assert get(dates.parse_rfc1123z, "Mon, 02 Jan 2006 15:04:05 GMT") is None
    assert get(dates.parse_card_stamp, "14:19 13.08.2026") == utc(2026, 8, 13, 11, 19)
    assert get(dates.parse_card_stamp, "Salary level") is None


def test_ages(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    for ts, words in {
        "2026-01-09 23:00:01": "59m ago",
        "2026-01-09 23:00:00": "1h ago",
        "2026-01-08 00:00:01": "47h ago",
        "2026-01-08 00:00:00": "2d ago",
        None: "–",
    }.items():
        assert one(spark, text.rel_time(F.col("t"), now), t=ts) == words


def test_small_splits(spark):
    company, title = text.split_company_title("t")
    assert one(spark, company, t="Acme: Dev: Go") == "Acme"
    assert one(spark, title, t="Acme: Dev: Go") == "Dev: Go"
    assert one(spark, company, t="Dev") == "" and one(spark, title, t=" Dev ") == "Dev"
    header, named = text.post_header("t")
    assert one(spark, header, t="Acme | Go | Remote. We do things") == "Acme | Go | Remote"
    assert one(spark, named, t="Acme.io | Go") == "Acme"
    assert one(spark, header, t=".starts with a dot") == ".starts with a dot"
    assert one(spark, named, t="|odd") == "|odd"
    assert one(spark, header, t="x" * 250 + ". y") == "x" * 250 + ". y"
    assert one(spark, text.fit_label("t"), t="home (berlin)") == "home"
    for label in ("New", "locations", "Undisclosed salary", "7d left", "12 000 - 15,5", "90 PLN/h"):
        assert one(spark, text.junk_tag("t"), t=label), label
    assert not one(spark, text.junk_tag("t"), t="B2B")


@pytest.mark.parametrize(
    "countries, place",
    [
        (None, "Remote, worldwide"),
        ([], "Remote, worldwide"),
        (["US", "CA"], None),
        (["US", "de"], "Remote, Europe"),
        (["US", "bg", "DE"], "Bulgaria (remote)"),
        (["GB"], None),
    ],
)
def test_countries(spark, countries, place):
    frame = spark.createDataFrame([(countries,)], "c array<string>")
    assert values(frame, text.countries_to_location("c")) == [place]

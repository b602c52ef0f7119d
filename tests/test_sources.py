import datetime as dt
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from helpers import raw, values
from pyspark.sql import functions as F

from listsieve import schema as sc
from listsieve.operators.attribution import attribute_events
from listsieve.operators.dedupe import first_wins
from listsieve.sources import cards, embedded, feeds, html_nodes, json_objects, markdown, search, threads
from listsieve.sources import raw as rw
from listsieve.sources.boards import Settings, Source, Sources, union_sources


def test_json_feed(spark):
    body = json.dumps(
        [
            {"legal": "notice"},
            {"position": "Dev", "company": "A", "url": "u1", "tags": ["x", "y"], "location": "EU",
             "description": "<p>Go &amp; more</p>", "date": "2026-01-02T03:04:05+00:00"},
            {"position": "Dev", "url": "u1", "date": "soon"},
            {"position": "", "url": "u2"},
        ]
    )
    pages = raw(spark, body, "[{broken")
    got = feeds.read_json_feed(pages)
    assert got.columns == sc.ADS.names
    rows = sorted(got.collect(), key=lambda r: r.arrival.pos)
    assert [(r.title, r.company, r.url, r.tags, r.description) for r in rows] == [
        ("Dev", "A", "u1", ["x", "y"], "Go & more"),
        ("Dev", "", "u1", [], ""),
    ]
    assert rows[0].posted_at == dt.datetime(2026, 1, 2, 3, 4, 5) and rows[1].posted_at is None
    assert sorted(values(feeds.json_feed_pages(pages), "ok")) == [False, True]


def test_nested_feed_unites_pages_and_keeps_the_first(spark):
    def page(*jobs):
        return json.dumps({"jobs": list(jobs)})

    pages = raw(
        spark,
        page({"url": "u1", "title": "first", "tags": ["a"], "job_type": "contract", "publication_date": "2026-01-02T03:04:05"}),
        page({"url": "u1", "title": "second"}, {"url": "u2", "title": "other", "publication_date": "2026-01-02"}),
        "not json",
    )
    got = feeds.read_nested_json_feed(pages)
    assert sorted(values(got, "url", "title", "tags", "posted_at")) == [
        ("u1", "first", ["a", "contract"], dt.datetime(2026, 1, 2, 3, 4, 5)),
        ("u2", "other", [], None),
    ]
    report = rw.ingest_report(feeds.nested_json_feed_pages(pages), got)
    assert values(report, "pages_ok", "pages_failed", "ads", "failed") == [(2, 1, 2, False)]
    nothing = raw(spark, "not json")
    report = rw.ingest_report(feeds.nested_json_feed_pages(nothing), feeds.read_nested_json_feed(nothing))
    assert values(report, "ads", "failed") == [(0, True)]


def test_rss(spark):
    body = """<?xml version="1.0"?><rss><channel><title>Jobs</title>
    <item><title>Acme: Dev: Go</title><link>u1</link><region>EU &amp;amp; UK</region>
      <description><![CDATA[<b>We</b> hire]]></description><pubDate>Mon, 05 Jan 2026 15:04:05 +0000</pubDate></item>
    <item><title>No colon</title><link>u2</link><pubDate>yesterday</pubDate></item>
    <item><title>Again: x</title><link>u1</link></item></channel></rss>"""
    got = feeds.read_rss(raw(spark, body, "<rss><channel>"))
    assert sorted(values(got, "url", "company", "title", "location", "description", "posted_at")) == [
        ("u1", "Acme", "Dev: Go", "EU & UK", "We hire", dt.datetime(2026, 1, 5, 15, 4, 5)),
        ("u2", "", "No colon", "", "", None),
    ]


def test_thread(spark):
    hits = raw(spark, json.dumps({"hits": [{"objectID": "1", "title": "Who wants?"}, {"objectID": "2", "title": "Who Is Hiring (May)"}, {"objectID": "3", "title": "who is hiring"}]}))
    assert threads.require_thread(threads.search_hits(hits)) == "2"
    with pytest.raises(LookupError):
        threads.require_thread(threads.search_hits(hits), "freelancers")
    body = json.dumps(
        {"id": 1, "children": [
            {"id": 7, "text": "Acme | Go | Remote<p>We hire.", "created_at": "2026-01-02T03:04:05.000Z",
             "children": [{"id": 9, "text": "remote reply"}]},
            {"id": 8, "text": "On site only"},
            {"id": 9, "text": None},
            {"id": 10, "text": "x" * 150 + " REMOTE " + "y" * 2100},
        ]}
    )
    got = sorted(threads.thread_to_ads(raw(spark, body), "Remote").collect(), key=lambda r: r.arrival.pos)
    assert [(r.url[-2:], r.company) for r in got] == [("=7", "Acme"), ("10", "x" * 60 + "…")]
    assert got[0].title == "Acme | Go | Remote We hire" and got[0].location == "see post"
    assert got[0].posted_at == dt.datetime(2026, 1, 2, 3, 4, 5)
    assert len(got[1].title) == 141 and len(got[1].description) == 2001
    assert threads.thread_to_ads(raw(spark, body)).count() == 3


def test_whole_descriptions(spark):
    """Without a limit a text is kept to its end; with one it is cut there."""
    long = "é" * 3000
    feed = raw(spark, json.dumps([{"position": "Dev", "url": "u1", "description": long}]))
    nested = raw(spark, json.dumps({"jobs": [{"title": "Dev", "url": "u1", "description": long}]}))
    rss = raw(spark, f"<rss><channel><item><title>A: B</title><link>u1</link><description>{long}</description></item></channel></rss>")
    thread = raw(spark, json.dumps({"id": 1, "children": [{"id": 7, "text": long}]}))
    card = raw(spark, FULL.replace("Only this", long))
    readers = [(feeds.read_json_feed, feed), (feeds.read_nested_json_feed, nested), (feeds.read_rss, rss),
               (threads.thread_to_ads, thread), (cards.read_full_cards, card)]
    for read, pages in readers:
        of = lambda **limit: max(values(read(pages, **limit), "description"), key=len)  # noqa: B023, E731
        assert of(max_bytes=None).startswith(long), read
        assert of(max_bytes=101) == "é" * 50 + "…" and len(of()) < len(long), read
    whole = Sources({"remoteok": Settings(whole_descriptions=True)})
    assert values(whole.read("remoteok", feed), "description") == [long]
    assert len(values(Sources().read("remoteok", feed), "description")[0]) == 1001
    page = raw(spark, f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "description": long})}</script>')
    assert values(embedded.extract_jsonld(page, None), "description") == [long]
    assert len(values(embedded.extract_jsonld(page), "description")[0]) == 1501


def test_all_tags(spark):
    """Without a limit all tags stay."""
    job = {"title": "Dev", "urlString": "a", "requiredCountries": ["DE"], "categories": [{"name": f"c{i}"} for i in range(20)]}
    data = json.dumps({"props": {"pageProps": {"externalJobs": [job]}}})
    page = raw(spark, f'<script id="__NEXT_DATA__" type="application/json">{data}</script>')
    sizes = [len(values(embedded.read_embedded_json(page, max_categories=n), "tags")[0]) for n in (None, 15, 3)]
    assert sizes == [20, 15, 3]
    labels = "".join(f"<span>t{i}</span>" for i in range(20)) + "<span>a label that is too long</span>"
    link = raw(spark, f'<li><div><h3><a class="offer_list_offer_title_link" href="u">Dev</a></h3></div><p>Acme</p>{labels}</li>')
    assert len(values(cards.read_link_cards(link), "tags")[0]) == 15
    assert len(values(cards.read_link_cards(link, max_tags=None, max_tag_bytes=40), "tags")[0]) == 21


def test_embedded_json(spark):
    job = {
        "randomKey": "k1", "title": "Dev", "jobType": "permanent", "requiredCountries": ["DE"],
        "experienceLevels": ["senior"], "urlString": "acme-dev", "postedAt": 1786327771,
        "company": {"name": "acme"}, "categories": [{"name": f"c{i}"} for i in range(20)],
    }
    jobs = [job, {**job, "requiredCountries": ["US"], "randomKey": "k2"}, {**job, "title": "", "randomKey": "k3"},
            {**job, "requiredCountries": None, "randomKey": "k4", "jobType": "", "postedAt": 0, "categories": None}]
    data = json.dumps({"props": {"pageProps": {"externalJobs": jobs}}})
    page = f'<html>\n<script id="__NEXT_DATA__" type="application/json">{data}</script><script>1</script></html>'
    pages = raw(spark, page, "<html>no data</html>")
    got = sorted(embedded.read_embedded_json(pages).collect(), key=lambda r: r.arrival.pos)
    assert [r.location for r in got] == ["Remote, Europe", "Remote, worldwide"]
    assert got[0].url == "https://arc.dev/remote-jobs/j/acme-dev-k1" and got[0].company == "acme"
    assert got[0].tags == [f"c{i}" for i in range(15)] + ["senior", "permanent"]
    assert got[1].tags == ["senior"] and got[1].description == "senior" and got[1].posted_at is None
    assert sorted(values(embedded.embedded_pages(pages), "ok")) == [False, True]


def test_jsonld(spark):
    def script(body):
        return f'<script type="application/ld+json">{body}</script>'

    found = script("{oops") + script('{"@type":"Organization","description":"no"}') + script(
        '{"@type":"JobPosting","description":"<p>Wir suchen</p>"}'
    ) + script('{"@type":"JobPosting","description":"later"}')
    pages = raw(spark, found, script('{"@type":"JobPosting","description":""}'))
    assert values(embedded.posting_results(pages), "success", "markdown") == [(True, "Wir suchen"), (False, "")]


def test_search_hits(spark):
    links = ["https://www.acme.test/jobs", "https://de.indeed.com/1", "https://www.acme.test/jobs", "", "http://bad host/"]
    body = json.dumps({"organic": [{"title": f"t{i}", "link": u, "snippet": "s"} for i, u in enumerate(links)]})
    got = search.hits_to_ads(raw(spark, body))
    assert values(got, "title", "company", "url", "description") == [("t0", "acme.test", links[0], "s")]


FULL = """<ul><div id="x" class="job-item card"><a href="/jobs/1-dev/" class="job_item__header-link d"><header>
<div><h2 class="job-item__position fs">Dev &amp; Ops</h2><span class="small grey">Acme</span></div>
<span title="Salary">$$</span></header></a><div><span>Full Remote</span><span class="location-text">Europe</span></div>
<div class="job-item__tags"><span class="badge">Go</span><span class="badge"> </span><span class="badge">Go</span></div>
<span class="badge">elsewhere</span><span class="js-truncated-text">short...</span>
<span class="js-original-text d-none"><p>Long <b>text</b></p><ul><li>one<li>two</ul></span>
<span title="14:19 13.08.2026">15m</span></div>
<div class="job-item"><a class="job_item__header-link" href="https://o.test/2"><h2 class="job-item__position">Two</h2></a>
<span class="location-text">Kyiv</span><span class="js-truncated-text">Only this</span></div>
<div class="job-item"><h2 class="job-item__position">No link</h2></div></ul>"""


def test_full_cards(spark):
    got = {r.title: r for r in cards.read_full_cards(raw(spark, FULL, "<p>none</p>", FULL)).collect()}
    assert set(got) == {"Dev & Ops", "Two"}
    one, two = got["Dev & Ops"], got["Two"]
    assert (one.company, one.location, one.url) == ("Acme", "Europe (remote)", "https://djinni.co/jobs/1-dev/")
    assert (one.tags, one.description) == (["Go"], "Long textonetwo")
    assert one.posted_at == dt.datetime(2026, 8, 13, 11, 19)
    assert (two.company, two.location, two.description, two.posted_at) == ("", "Kyiv", "Only this", None)


def test_title_cards(spark):
    body = """<div class="job-list-item"><a class="overlay-link" href="https://dev.bg/1"></a><h6 class="job-title"> Dev </h6>
    <span class="company-name">Acme</span><span class="badge is-remote"></span></div>
    <div class="job-list-item"><a class="overlay-link" href="https://dev.bg/2"></a><h6 class="job-title">Ops</h6></div>
    <div class="job-list-item"><h6 class="job-title">No link</h6></div>"""
    got = cards.read_title_cards(raw(spark, body))
    assert sorted(values(got, "title", "company", "location", "url", "description")) == [
        ("Dev", "Acme", "Bulgaria (remote)", "https://h512.com/1", "go"),
        ("Ops", "", "Bulgaria", "https://h512.com/2", "go"),
    ]


def test_link_cards(spark):
    def card(url, middle):
        return f'<li><div><div><h3><a class="offer_list_offer_title_link" href="{url}">Dev {url}</a></h3></div></div>{middle}</li>'

    body = (
        card("u1", "<p>Acme</p><div><span>Go</span><span>New</span><span>3d left</span><span>Go</span></div><span>a label that is too long</span>")
        + card("u2", "<p>Remote</p><div>B2B</div><span>100 EUR/h</span>")
        + card("u1", "<p>Again</p>")
    )
    got = cards.read_link_cards(raw(spark, f"<main>{body}</main>"))
    assert sorted(values(got, "url", "title", "company", "location", "tags", "description")) == [
        ("u1", "Dev u1", "Acme", "Poland", ["Go"], "Go"),
        ("u2", "Dev u2", "", "Remote, Europe", ["B2B"], "B2B"),
    ]


def test_page_nodes_come_in_slices_by_bytes(spark):
    page = "<p>%s</p>" + "<b>x</b>" * 3000
    bodies = [None if i % 7 == 0 else "" if i % 7 == 1 else page % i for i in range(200)]
    bodies[100] = "<i>y</i>" * (html_nodes.SLICE_BYTES // 4)  # more than a slice
    given = list(html_nodes.html_nodes.func(iter([pa.array(bodies[:90]), pa.array(bodies[90:]), pa.array([], pa.string())])))
    assert sum(len(some) for some in given) == 200 and len(given) > 4
    at = 0
    for some in given:
        own, at = bodies[at : at + len(some)], at + len(some)
        assert len(own) <= 1 or sum(len(b or "") for b in own) <= html_nodes.SLICE_BYTES
        assert [len(nodes) for nodes in some] == [len(html_nodes.nodes_of(b)) for b in own]
    pages = raw(spark, *bodies).coalesce(1).select("seq", html_nodes.html_nodes("body").alias("nodes"))
    got = dict(values(pages, "seq", F.try_element_at("nodes", F.lit(4))["text"]))
    assert got == {i: "y" if i == 100 else str(i) if b else None for i, b in enumerate(bodies)}


def test_nodes_of_title_pages_do_not_pile_up():
    card = '<div class="job-list-item"><a class="overlay-link" href="/%d"></a><h6 class="job-title">Dev</h6></div>'
    pages = pa.array(["".join(card % i for i in range(n, n + 100)) for n in range(500)])

    def peak(count):
        tracemalloc.start()
        for some in html_nodes.html_nodes.func(iter([pages[:count]])):
            assert len(some[0]) == 2 + 100 * 4
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert pages[:200].nbytes > 1.5 * html_nodes.SLICE_BYTES
    assert peak(500) < 1.3 * peak(200)


def test_markdown(spark):
    def skill(name, host="jobs"):
        return f"![{name}](https://static.{host}.bg/mobile/images/skills/x.png?v=1)"

    body = f"""
[{skill('SQL')}\\
{skill('Go')}](https://www.jobs.bg/job/11 "Support")

[![Logo](https://assets.test/l.png) Acme](https://www.jobs.bg/company/5?job=11 "Акме ЕООД")
[x](https://www.jobs.bg/job/11 "Senior Support Engineer")
[{skill('Rust', 'tech')}](https://www.tech.bg/job/22 "Rust Dev")
[c](https://www.tech.bg/company/beta-ltd "Beta")
[c](https://www.tech.bg/company/other "Late")
[c](https://www.jobs.bg/company/6?job=33 "Too early")
[y](https://www.jobs.bg/job/33 "Third")
"""
    got = sorted(markdown.read_markdown(raw(spark, body)).collect(), key=lambda r: r.arrival.pos)
    assert [(r.url[-2:], r.title, r.company, r.tags) for r in got] == [
        ("11", "Senior Support Engineer", "Акме ЕООД", ["SQL", "Go"]),
        ("22", "Rust Dev", "Beta", ["Rust"]),
        ("33", "Third", "", []),
    ]
    assert got[0].description == "SQL Go"


def test_attribution_is_the_same_for_any_chunking(spark):
    """One part holds most of the rows; compared with a plain walk."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(900):
        part = "hot" if rng.random() < 0.7 else f"p{rng.randrange(5)}"
        kind = rng.choice(["label", "label", "item", "note"])
        key = str(rng.randrange(6)) if kind == "item" or (kind == "note" and rng.random() < 0.4) else ""
        value = rng.choice(["", "a", "bb", "cc", "ddd"]) if kind != "label" else f"l{rng.randrange(9)}"
        rows.append((part, i, kind, key, value))

    def walk():
        out = {}
        for part in {r[0] for r in rows}:
            items, labels, last = {}, [], ""
            for _, pos, kind, key, value in (r for r in rows if r[0] == part):
                if kind == "label":
                    labels.append(value)
                elif kind == "item":
                    if key not in items:
                        items[key] = [pos, value, "", list(dict.fromkeys(labels))]
                    elif len(value) > len(items[key][1]):
                        items[key][1] = value
                    last, labels = key, []
                else:
                    item = items.get(key or last)
                    if item and not item[2]:
                        item[2] = value
            out.update({(part, k): tuple(v) for k, v in items.items()})
        return out

    events = spark.createDataFrame(rows, "page_url string, pos int, kind string, key string, value string")
    expected = walk()
    for chunk in (None, F.floor(F.col("pos") / 10), F.col("pos")):
        got = attribute_events(events, chunk=chunk).collect()
        assert {(r.page_url, r.key): (r.first_pos, r.title, r.company, r.tags) for r in got} == expected


def test_first_wins_with_one_key_holding_most_rows(spark):
    rows = [("s", "hot" if i % 3 else f"u{i}", i) for i in range(300)]
    frame = spark.createDataFrame(rows, "source string, url string, arrival int").repartition(7)
    got = first_wins(frame)
    assert got.count() == 101 and values(got.filter("url = 'hot'"), "arrival") == [1]


def test_page_results(spark):
    body = json.dumps({"success": True, "data": {"markdown": "# x", "metadata": {"title": "T", "statusCode": 200}}})
    got = rw.fetched_page_results(raw(spark, body, '{"success": false, "error": "Rate limit"}', "junk"))
    assert values(got, "success", "markdown", "title", "error") == [
        (True, "# x", "T", ""), (False, "", "", "Rate limit"), (False, "", "", ""),
    ]
    assert rw.successful(got).count() == 1


def test_read_raw(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs":\n []}')
    (tmp_path / "b.json").write_text("x")
    got = rw.read_raw(spark, str(tmp_path))
    assert sorted(values(got, "body")) == ['x', '{"jobs":\n []}'] and got.columns == sc.RAW.names


def test_registry_and_union(spark):
    assert Sources().active() == ["remoteok", "remotive", "weworkremotely", "hackernews"]
    with pytest.raises(ValueError, match="unknown source"):
        Sources({"monster": Settings()})
    full = Sources({n: Settings(pages=("p",), queries=("q",)) for n in Sources().known})
    assert full.active() == list(full.known)
    assert full.verify_limits() == {"justjoin": 25} and full.max_pages() == 10
    assert "h512.com" in full.skip_list() and "linkedin.com" in full.skip_list()
    off = Sources({**full.settings, "devbg": Settings(enabled=False, pages=("p",))})
    assert "dev.bg" not in off.skip_list() and "dev.bg" not in values(off.skip_table(spark), "domain")
    assert Sources().categories() == ("software-dev",) and len(Sources().feeds()) == 1
    full.register(Source("mine", ("mine.test",), feeds.read_json_feed))
    assert "mine" in full.active()

    body = json.dumps([{"position": "Dev", "url": "u1"}])
    nested = json.dumps({"jobs": [{"url": "u1", "title": "Dev"}]})
    got = Sources().ingest({"remoteok": raw(spark, body), "remotive": raw(spark, nested), "serper": raw(spark, "{}")})
    assert sorted(values(got, "source", "arrival.source_ord")) == [("remoteok", 0), ("remotive", 1)]
    with pytest.raises(ValueError):
        union_sources({})


def test_big_json_objects_are_read_in_parts(spark, tmp_path):
    """Keys and texts full of braces, quotes, commas and backslashes, cut anywhere."""
    rng = random.Random(9)
    odd = ['{', '}', '"', ',', '\\', ': ', 'é', '\n', '","', '{"a": 1}', 'x' * 30]
    entries = {
        f"k{i}{rng.choice(odd)}": {"id": None if i % 3 else f"id{i}", "title": "".join(rng.choices(odd, k=rng.randint(0, 6))),
                 "tags": ["}", "{"][: i % 3], "extra": {"deep": [{"x": "}"}]} if i % 7 == 0 else None}
        for i in range(200)
    }
    times = {f"https://e.test/{i},{rng.choice(odd)}": f"2026-01-{i % 28 + 1:02}T00:00:00Z" for i in range(150)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, text in (("compact", json.dumps(entries)), ("spread", json.dumps(entries, indent=2, ensure_ascii=False))):
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        for size in (old, "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            parts = json_objects.segments(spark, str(path), "{").rdd.getNumPartitions()
            assert parts > 5 or size == old
            got = {r.key: json.loads(r.value) for r in json_objects.object_entries(spark, str(path)).collect()}
            assert got == entries
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    (tmp_path / "times.json").write_text(json.dumps(times))
    assert dict(map(tuple, json_objects.text_entries(spark, str(tmp_path / "times.json")).collect())) == times
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    for empty in ("{}", " {\n}\n"):
        (tmp_path / "empty.json").write_text(empty)
        assert json_objects.object_entries(spark, str(tmp_path / "empty.json")).count() == 0
        assert json_objects.text_entries(spark, str(tmp_path / "empty.json")).count() == 0

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from helpers import ads, at, empty_state, values
from pyspark.sql import functions as F

from listsieve import Keyword, Profile
from listsieve import schema as sc
from listsieve.operators.budget import budget
from listsieve.operators.enrich import enrich, update_crawled, verify
from listsieve.operators.lookup import derive_skip_domains, not_crawled, skip_domains
from listsieve.operators.merge import merge, merge_fresh, merge_state, prepare, retain
from listsieve.operators.updates import apply_updates
from listsieve.operators.views import digest, export_json, facets, list_ads, status_choices
from listsieve.plans.run import run_once
from listsieve.sources import state_store as st

T0, T1 = "2026-01-01 00:00:00", "2026-01-01 01:00:00"
BASE = dict(source="b", company="Acme", title="Go Dev")
GO = Profile(keywords=(Keyword("go", 4),), min_score=4)


def arriving(rows):
    """Ads in the order of ``seq``, as sources emit them."""
    return rows.withColumn("arrival", sc.arrival(0, F.col("seq")))


def merged(spark, state, now, *rows, **options):
    new_state, fresh = merge(state, ads(spark, *rows, **BASE), at(now), order="seq", **options)
    return new_state, fresh


def test_merge_is_idempotent_and_normalises(spark):
    rows = [dict(url="https://e.com/1?x=7&srsltid=a")]
    state, fresh = merged(spark, empty_state(spark), T0, *rows)
    assert values(fresh, "url", "last_seen") == [("https://e.com/1?x=7", None)]
    again, none = merged(spark, state, T1, dict(url="https://e.com/1?x=7&srsltid=b", title="Go Developer"))
    assert none.count() == 0
    row = again.collect()
    assert len(row) == 1 and row[0].title == "Go Developer"
    assert (row[0].first_seen, row[0].last_seen) == (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 1))
    assert again.columns == sc.STATE.names


def test_status_survives_merge_and_hidden_sticks(spark):
    state, fresh = merged(spark, empty_state(spark), T0, dict(url="u1"), dict(url="u2"))
    ids = dict(values(fresh, "url", "id"))
    updates = spark.createDataFrame(
        [(ids["u1"], True, "applied"), (ids["u2"], None, "lost"), ("nope", True, None)],
        "id string, hidden boolean, status string",
    )
    changed = apply_updates(state, updates, at(T0), order="id")
    assert sorted(values(changed.rejected, "id", "problem")) == sorted(
        [(ids["u2"], "unknown status"), ("nope", "unknown id")]
    )
    after, fresh = merged(spark, changed.state, T1, dict(url="u1"), dict(url="u2", hidden=True))
    assert fresh.count() == 0
    assert sorted(values(after, "url", "hidden", "status")) == [("u1", True, "applied"), ("u2", True, "")]
    # 90 days on, the untracked row is gone and the tracked one is not.
    later = merge_state(after, ads(spark, dict(url="u9"), **BASE), at("2026-04-02 00:00:00"), "seq")
    assert sorted(values(later, "url")) == ["u1", "u9"]
    cleared = apply_updates(
        after, spark.createDataFrame([(ids["u1"], "")], "id string, status string"), at(T1), order="id"
    )
    assert values(cleared.state.filter("url = 'u1'"), "status", "status_at", "hidden") == [("", None, True)]


def test_last_update_of_each_field_wins(spark):
    state, fresh = merged(spark, empty_state(spark), T0, dict(url="u1"))
    key = values(fresh, "id")[0]
    updates = spark.createDataFrame(
        [(key, True, None, 1), (key, None, "applied", 2), (key, False, None, 3), (key, None, "declined", 0)],
        "id string, hidden boolean, status string, n int",
    )
    out = apply_updates(state, updates, at(T1), order="n").state
    assert values(out, "hidden", "status") == [(False, "applied")]


def test_hidden_content_suppresses_siblings_only_when_stored_before(spark):
    state, _ = merged(spark, empty_state(spark), T0, dict(url="gone", hidden=True))
    rows = [
        dict(url="sibling"),
        dict(url="other", title="Other"),
        dict(url="pair-1", title="Pair", hidden=True),
        dict(url="pair-2", title="Pair"),
    ]
    for salt in (1, 16):
        after, fresh = merged(spark, state, T1, *rows, salt=salt)
        assert sorted(values(fresh, "url")) == ["other", "pair-2"]
        assert sorted(values(after.filter("hidden"), "url")) == ["gone", "pair-1", "sibling"]


def test_repeats_in_a_batch(spark):
    """First hidden, second hidden, both visible; the last text is stored."""
    rows = [
        dict(url="a", description="1", hidden=True), dict(url="a", description="2"),
        dict(url="b", description="1"), dict(url="b", description="2", hidden=True),
        dict(url="c", description="1"), dict(url="c?ref=1", description="2"),
    ]
    state, fresh = merged(spark, empty_state(spark), T0, *rows)
    assert sorted(values(fresh, "url", "description")) == [("b", "1"), ("c", "1")]
    assert sorted(values(state, "url", "description", "hidden")) == [
        ("a", "2", True), ("b", "2", True), ("c", "2", False),
    ]


def test_one_id_holding_a_third_of_the_batch(spark):
    """Checked against a plain loop over the rows in order."""
    rows = [
        dict(url="hot" if i % 3 == 0 else f"u{i % 50}", title=f"t{i % 7}", hidden=i % 97 == 5, description=str(i))
        for i in range(600)
    ]
    stored = [dict(url=f"u{i}", title=f"t{i % 7}", hidden=i % 4 == 0) for i in range(0, 50, 3)]
    state, _ = merged(spark, empty_state(spark), T0, *stored)
    after, fresh = merged(spark, state, T1, *rows)

    def expected():
        known = {r["url"]: dict(r) for r in stored}
        keys = {r["title"] for r in stored if r["hidden"]}
        new = []
        for r in rows:
            old = known.get(r["url"])
            hidden = r["hidden"] or (old["hidden"] if old else r["title"] in keys)
            if old is None and not hidden:
                new.append((r["url"], r["description"]))
            known[r["url"]] = {**r, "hidden": hidden}
        return known, new

    known, new = expected()
    assert sorted(values(fresh, "url", "description")) == sorted(new)
    assert sorted(values(after, "url", "title", "hidden")) == sorted(
        (u, r["title"], r["hidden"]) for u, r in known.items()
    )


def test_longer_description_can_be_kept(spark):
    state, _ = merged(spark, empty_state(spark), T0, dict(url="a", description="the whole page"))
    for keep, text in ((False, "card"), (True, "the whole page")):
        after, _ = merged(spark, state, T1, dict(url="a", description="card"), keep_longer_description=keep)
        assert values(after, "description") == [text]


def test_retention_is_strict(spark):
    rows = [("on", "", "2026-01-01 00:00:00"), ("late", "", "2025-12-31 23:59:59"), ("t", "applied", "2020-01-01 00:00:00")]
    state = spark.createDataFrame(rows, "id string, status string, seen string")
    state = state.withColumn("last_seen", F.col("seen").cast("timestamp"))
    assert sorted(values(retain(state, at("2026-03-02 00:00:00")), "id")) == ["on", "t"]


def test_crawl_cache_edges(spark):
    cache = spark.createDataFrame(
        [("u1", "2026-01-01 00:00:00"), ("u2", "2026-01-01 00:00:01"), ("u3", "2025-12-31 23:59:59")],
        "url string, t string",
    ).select("url", F.col("t").cast("timestamp").alias("crawled_at"))
    now = at("2026-01-31 00:00:00")
    rows = ads(spark, dict(url="u1"), dict(url="u2"), dict(url="u3"), dict(url="u4"))
    # Exactly 30 days old: not crawled any more, but not deleted yet.
    assert sorted(values(not_crawled(rows, cache, now), "url")) == ["u1", "u3", "u4"]
    new = spark.createDataFrame([("u1", "2026-01-31 00:00:00")], "url string, t string").select(
        "url", F.col("t").cast("timestamp").alias("crawled_at")
    )
    assert sorted(values(update_crawled(cache, new, now), "url")) == ["u1", "u2"]


PAGES = [
    ("ok", True, "you and the team with skills " * 3, "Page"),
    ("foreign", True, "wir suchen dich und deine erfahrung die der das", ""),
    ("failed", False, "", ""),
    ("late", True, "text", ""),
]


def page_table(spark):
    return spark.createDataFrame(PAGES, "url string, success boolean, markdown string, title string")


def cache_table(spark):
    return spark.createDataFrame([("cached",)], "url string").withColumn("crawled_at", at(T0))


def test_verify(spark):
    urls = ["cached", "missing", "ok", "foreign", "failed", "late"]
    rows = ads(spark, *[dict(url=u, source="v") for u in urls], dict(url="x", source="free"), title="Dev")
    profile = Profile(keywords=(Keyword("go"),), languages=("en",))
    out = verify(rows, page_table(spark), cache_table(spark), {"v": 4, "w": 0}, profile, at(T1), order="seq")
    assert sorted(values(out.ads, "url", "hidden")) == [("cached", False), ("foreign", True), ("ok", False), ("x", False)]
    texts = dict(values(out.ads, "url", "description"))
    assert texts["ok"].startswith("you and") and texts["foreign"] == "" and texts["x"] == ""
    assert sorted(values(out.crawled, "url")) == ["foreign", "ok"]
    assert values(out.metrics, "source", "fetched", "rejected") == [("v", 4, 1)]
    passing = verify(rows, page_table(spark), cache_table(spark), {}, profile, at(T1), order="seq")
    assert passing.ads.count() == 7


def test_verify_has_a_budget_per_source(spark):
    rows = ads(spark, *[dict(url=u, source=s, title="Dev") for s in "ab" for u in ("ok", "foreign", "late")])
    profile = Profile(keywords=(Keyword("go"),), languages=("en",))
    out = verify(rows, page_table(spark), cache_table(spark), {"a": 1, "b": 2}, profile, at(T1), order="seq")
    assert sorted(values(out.ads, "source", "url")) == [("a", "ok"), ("b", "foreign"), ("b", "ok")]


def test_enrich(spark):
    hits = ads(
        spark, *[dict(url=u, description="snippet", title=f"t-{u}") for u in ("cached", "failed", "ok", "late")]
    )
    out = enrich(hits, page_table(spark), cache_table(spark), at(T1), 2, order="seq")
    got = {u: (t, d) for u, t, d in values(out.ads, "url", "title", "description")}
    assert got["ok"][0] == "Page" and got["ok"][1].startswith("you and the team")
    for url in ("cached", "failed", "late"):
        assert got[url] == (f"t-{url}", "snippet")
    assert values(out.crawled, "url") == ["ok"]
    for limit, size in ((None, 3 * len("you and the team with skills ") - 1), (10, 11)):
        cut = enrich(hits, page_table(spark), cache_table(spark), at(T1), 2, order="seq", max_bytes=limit)
        assert [len(d) for u, d in values(cut.ads, "url", "description") if u == "ok"] == [size]


def test_domains(spark):
    rows = spark.createDataFrame(
        [(u,) for u in ("https://www.LinkedIn.com/x", "https://dropbox.com/", "https://careers.test/", "https://bad host/", "")],
        "url string",
    )
    keep = sorted(values(skip_domains(rows, ["linkedin.com", "x.com"]), "url"))
    assert keep == ["", "https://careers.test/"]
    covered = {"on": ["careers.test"], "off": ["other.test"]}
    table = derive_skip_domains(spark, covered, lambda n: n == "on", ["extra."])
    assert "other.test" not in values(table, "domain")
    assert sorted(values(skip_domains(rows, table), "url")) == [""]


def listing(spark):
    rows = [
        dict(url="1", source="a", score=5, fit="home (x)", title="Go dev"),
        dict(url="2", source="b", score=-1, fit="away", title="Go dev"),
        dict(url="3", source="a", score=7, fit="away (unverified)", description="GO here"),
        dict(url="4", source="c", score=9, fit="", hidden=True),
    ]
    fits = [r["fit"] for r in rows]
    frame = ads(spark, *rows)
    frame = frame.withColumn("fit", F.element_at(F.array(*[F.lit(f) for f in fits]), (F.col("seq") + 1).cast("int")))
    frame = frame.withColumn("status", F.when(F.col("url") == "3", "applied").otherwise(""))
    return sc.conform(frame.withColumn("id", F.col("url")), sc.STATE)


@pytest.mark.parametrize(
    "filters, urls",
    [
        ({}, ["3", "1"]),
        ({"min": -5}, ["3", "1", "2"]),
        ({"min": "junk"}, ["3", "1"]),
        ({"min": "6"}, ["3"]),
        ({"hidden": "1"}, ["4"]),
        ({"hidden": "yes"}, ["3", "1"]),
        ({"source": "a", "fit": "away"}, ["3"]),
        ({"status": "tracked"}, ["3"]),
        ({"status": "none"}, ["1"]),
        ({"status": "applied"}, ["3"]),
        ({"status": "unknown"}, []),
        ({"q": "GO"}, ["3", "1"]),
        ({"limit": 1}, ["3"]),
    ],
)
def test_list(spark, filters, urls):
    assert values(list_ads(listing(spark), **filters), "url") == urls


def test_facets_digest_and_export(spark, tmp_path):
    state = listing(spark)
    assert values(facets(state), "facet", "value") == [
        ("source", "a"), ("source", "b"), ("source", "c"), ("fit", "away"), ("fit", "home"),
    ]
    assert [v for v, _ in status_choices()] == ["", "none", "tracked", "applied", "interviewing", "declined"]
    fresh = merge_fresh(empty_state(spark), ads(spark, *[dict(url=f"u{i}", score=i) for i in range(12)], **BASE), at(T0), "seq")
    message = values(digest(fresh, order="seq"), "text")[0]
    assert message.startswith("🔍 12 new job match(es)\n\n• [0] Go Dev — Acme (, b)\nu0\n\n• [1]")
    assert message.endswith("u9\n\n… and 2 more\n")
    assert digest(fresh.limit(0), order="seq").count() == 0
    export_json(list_ads(state), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_snapshots(spark, tmp_path):
    store = st.StateStore(spark, str(tmp_path / "state"), buckets=4)
    assert store.version() is None and store.load().count() == 0
    batch = ads(spark, *[dict(url=f"u{i}") for i in range(20)], **BASE)
    assert store.save(merge_state(store.load(), batch, at(T0), "seq"), batch="first") == 0
    assert store.save(store.load().limit(0), batch="first") == 0  # taken in before
    more = ads(spark, *[dict(url=f"u{i}") for i in range(10, 30)], **BASE)
    after = merge_state(store.load(), more, at(T1), "seq")
    plan = after._jdf.queryExecution().executedPlan().toString()
    # The state is joined where it lies: no exchange between its scan and the join.
    state_side = plan.split("SortMergeJoin", 1)[1].split("FileScan", 1)[0]
    assert "Bucketed: true" in plan and "Exchange" not in state_side
    assert store.save(after, placed=True) == 1
    with pytest.raises(ValueError, match="4 buckets"):
        st.StateStore(spark, str(tmp_path / "state"), buckets=8)
    again = st.StateStore(spark, str(tmp_path / "state"))
    assert again.buckets == 4 and again.load().groupBy("id").count().count() == 30
    assert (again.version(), again.load().count(), again.load().schema.names) == (1, 30, sc.STATE.names)
    assert len(list((tmp_path / "state" / "state").glob("*/bucket=*/*.parquet"))) <= 8
    assert store.expire(keep=1) == [0]
    assert store.has_batch("first") and len(list((tmp_path / "state" / "state").glob("*/bucket=*/*.parquet"))) <= 4
    assert store.load().count() == 30


def one_row(spark, store, url, now=T0):
    """A merge of one listing, as ``update`` takes it."""
    rows = prepare(ads(spark, dict(url=url), **BASE), order="seq")

    def change(base):
        return {"state": merge_state(store.load(base), rows, at(now), "seq", prepared=True)}

    return change


def test_the_second_of_two_writers_merges_again(spark, tmp_path):
    first, second = (st.StateStore(spark, str(tmp_path / "state"), buckets=2) for _ in range(2))
    first.save(one_row(spark, first, "u0")(None)["state"])
    stale = one_row(spark, second, "u9")(None)["state"]  # both have read version 0
    first.load(), second.load()
    assert first.save(one_row(spark, first, "u1")(None)["state"], batch="a-0") == 1
    with pytest.raises(st.Conflict):
        second.save(stale)
    assert sorted(values(second.load(), "url")) == ["u0", "u1"]
    # a change during which the other one commits: done again, nothing is lost
    seen = []

    def change(base):
        seen.append(base)
        if len(seen) == 1:
            first.update(one_row(spark, first, "u2"), batch="a-1")
        return one_row(spark, second, "u3")(base)

    assert second.update(change, batch="b-0") == 3
    assert seen == [1, 2]
    assert sorted(values(first.load(), "url")) == ["u0", "u1", "u2", "u3"]
    assert first.has_batch("b-0") and first.has_batch("a-1") and not first.has_batch("a-2")
    assert second.update(change, batch="a-1") == 3 and len(seen) == 2  # taken in before
    # names of a stream's batches are its last number alone
    assert first.manifest(3).streams == {"a": 1, "b": 0} and first.manifest(3).batches == []
    with pytest.raises(st.Conflict):
        second.update(lambda base: (first.update(one_row(spark, first, f"x{base}")), change(base))[1], attempts=2)


def test_writers_at_the_same_moment(spark, tmp_path):
    stores = [st.StateStore(spark, str(tmp_path / "state"), buckets=2) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda i: stores[i].update(one_row(spark, stores[i], f"u{i}"), batch=f"w{i}-0"), range(4)))
    assert sorted(versions) == [0, 1, 2, 3]
    assert sorted(values(stores[0].load(), "url")) == ["u0", "u1", "u2", "u3"]


def test_a_number_that_has_expired_cannot_be_claimed(spark, tmp_path):
    store = st.StateStore(spark, str(tmp_path / "state"), buckets=2)
    for i in range(4):
        store.update(one_row(spark, store, f"u{i}"))
    assert store.expire(keep=2) == [0, 1]
    with pytest.raises(st.Conflict):
        store._claim(st.Manifest(1))
    assert store._versions() == [2, 3]


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = tmp_path / "state" / "state"
    store = st.StateStore(spark, str(tmp_path / "state"), buckets=8)
    run_once(store, arriving(ads(spark, *[dict(url=f"u{i}", description="go") for i in range(60)], **BASE)), GO, T0)
    before = {p.name for p in folder.iterdir()}
    batch = arriving(ads(spark, dict(url="u7", description="go go"), **BASE))
    run = run_once(store, batch, GO, "2026-02-01 00:00:00")
    written = [p for p in folder.iterdir() if p.name not in before]
    assert len(written) == 1 and len([p for p in written[0].iterdir() if p.name.startswith("bucket=")]) == 1
    assert run.fresh.count() == 0 and store.load().count() == 60
    # rows that have gone stale are left out on reading, though their buckets were not written
    run_once(store, batch, GO, "2026-03-15 00:00:00")
    assert values(store.load(), "url") == ["u7"]
    # and count as never seen when they come again
    run = run_once(store, arriving(ads(spark, dict(url="u8", description="go"), **BASE)), GO, "2026-03-16 00:00:00")
    assert values(run.fresh, "url") == ["u8"]
    assert sorted(values(store.load(), "url", "first_seen")) == [("u7", dt.datetime(2026, 1, 1)), ("u8", dt.datetime(2026, 3, 16))]
    store.expire(keep=1)
    assert sorted(values(store.load(), "url")) == ["u7", "u8"]


def test_legacy_state(spark, tmp_path):
    path = tmp_path / "jobs.json"
    path.write_text(
        """{"abc": {"id": "abc", "source": "t", "title": "Dev", "url": "u", "score": 5, "tags": ["x"],
        "first_seen": "2026-01-01T00:00:00Z", "last_seen": "2026-01-02T00:00:00Z",
        "posted_at": "0001-01-01T00:00:00Z", "applied": true, "applied_at": "2026-01-03T00:00:00Z"},
        "def": {"id": "def", "status": "declined", "status_at": "2026-01-04T00:00:00Z", "applied": true}}"""
    )
    rows = {r.id: r for r in st.load_state(spark, str(path)).collect()}
    assert (rows["abc"].status, rows["abc"].status_at) == ("applied", dt.datetime(2026, 1, 3))
    assert rows["abc"].posted_at is None and rows["abc"].tags == ["x"] and rows["abc"].hidden is False
    assert (rows["def"].status, rows["def"].title) == ("declined", "")
    assert st.load_state(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "crawled.json").write_text('{"u1": "2026-01-01T00:00:00Z"}')
    assert values(st.load_crawled(spark, str(tmp_path / "crawled.json")), "url") == ["u1"]


def test_budget_above_the_group_limit(spark):
    rows = spark.range(4000).selectExpr("id AS seq", "if(id % 4 = 0, 'b', 'a') AS source")
    got = values(budget(rows, 1200, "source", "seq"), "source", "seq")
    want = [(s, i) for s in "ab" for i in [i for i in range(4000) if (i % 4 == 0) == (s == "b")][:1200]]
    assert sorted(got) == sorted(want)

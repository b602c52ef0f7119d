import datetime as dt
import json
import random

import pandas as pd
from helpers import values
from pyspark.sql import functions as F

from listsieve import Keyword, Profile
from listsieve.plans.run import run_once, start_up
from listsieve.sources import feeds, threads
from listsieve.sources.boards import Settings, Sources
from listsieve.sources.raw import fetched_pages
from listsieve.sources.state_store import StateStore
from listsieve.streaming import keyed_state, micro_batch, seen

PROFILE = Profile(keywords=(Keyword("go", 4),), min_score=4, languages=("en", "de"))
T0 = "2026-01-01 00:00:00"


def page(*jobs):
    return json.dumps([{"position": t, "url": u, "description": "Go services"} for t, u in jobs])


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    store = StateStore(spark, str(tmp_path / "state"), buckets=2)
    messages = []

    def start():
        query = micro_batch.start_from_files(
            spark, str(landing), store, PROFILE, str(tmp_path / "checkpoint"),
            read=feeds.read_json_feed, now=lambda *_: T0, interval=None,
            on_run=lambda run, i: messages.append([r.text for r in run.digest.collect()]),
        )
        query.awaitTermination()

    (landing / "1.json").write_text(page(("Go Dev", "u1"), ("Baker", "u0")))
    start()
    (landing / "2.json").write_text(page(("Go Dev II", "u1?ref=9"), ("Go Lead", "u2")))
    start()
    start()
    assert store.version() == 1  # two batches, two versions
    # Another stream, with a checkpoint of its own, into the same store: its batches are new.
    more = tmp_path / "more"
    more.mkdir()
    (more / "1.json").write_text(page(("Go Ops", "u3")))
    for _ in range(2):
        micro_batch.start_from_files(
            spark, str(more), store, PROFILE, str(tmp_path / "other"),
            read=feeds.read_json_feed, now=lambda *_: T0, interval=None,
        ).awaitTermination()
    assert store.version() == 2 and "u3" in values(store.load(), "url")
    (landing / "3.json").write_text(page(("Go Ops", "u3")))
    assert sorted(values(store.load(), "url", "title")) == [
        ("u0", "Baker"), ("u1", "Go Dev II"), ("u2", "Go Lead"), ("u3", "Go Ops"),
    ]
    assert ["2 new" in m[0] for m in messages] == [True, False] and "1 new" in messages[1][0]

    everything = feeds.read_json_feed(micro_batch_raw(spark, landing))
    other = StateStore(spark, str(tmp_path / "batch"), buckets=2)
    run_once(other, everything, PROFILE, T0)
    ids = sorted(values(store.load(), "id"))
    assert sorted(values(other.load(), "id")) == ids


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    """The checkpoint forgets its last commit, so the stream hands the batch out once more."""
    landing = tmp_path / "landing"
    landing.mkdir()
    store = StateStore(spark, str(tmp_path / "state"), buckets=2)
    handed, done = [], []

    def read(rows):
        handed.append(rows.count())
        return feeds.read_json_feed(rows)

    def start(profile=PROFILE):
        micro_batch.start_from_files(
            spark, str(landing), store, profile, str(tmp_path / "checkpoint"), read=read, now=lambda *_: T0,
            interval=None, on_run=lambda run, i: done.append(i), keep_versions=2,
        ).awaitTermination()

    for i in range(4):
        (landing / f"{i}.json").write_text(page((f"Go {i}", f"u{i}")))
        start()
    assert store.version() == 3 and store._versions() == [2, 3] and done == [0, 1, 2, 3]
    assert list(store.manifest(3).streams.values()) == [3] and store.manifest(3).batches == []
    before = sorted(values(store.load(), "url", "title"))
    for crc in ("", "."):
        last = tmp_path / "checkpoint" / "commits" / (f".{3}.crc" if crc else "3")
        last.unlink()
    batches = []
    asked = store.has_batch
    store.has_batch = lambda b: batches.append(b) or asked(b)
    start()
    assert [b.rpartition("-")[2] for b in batches] == ["3"] and len(handed) == 4  # came again, was not read
    assert store.version() == 3 and done == [0, 1, 2, 3]
    assert sorted(values(store.load(), "url", "title")) == before
    # a changed profile purges what is stored before the next trigger
    (landing / "9.json").write_text(page(("Go 9", "u9")))
    start(Profile(keywords=(Keyword("go", 4),), min_score=4, exclude_companies=("",), languages=("de",)))
    assert store.manifest(store.version()).profile is not None


def test_start_up_purges_once_for_a_profile(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"), buckets=2)
    assert start_up(store, PROFILE) == 0 and store.version() is None
    body = json.dumps([{"position": f"Go {c}", "company": c, "url": f"u{c}", "description": "Go"} for c in ("Acme", "Bad", "Ugly")])
    ads = feeds.read_json_feed(spark.createDataFrame([("p", body, 0)], "page_url string, body string, seq long"))
    pages = spark.createDataFrame([("remoteok", True), ("remoteok", False), ("djinni", False)], "source string, ok boolean")
    run = run_once(store, ads, PROFILE, T0, pages_read=pages)
    assert sorted(values(run.pages, "source", "pages_ok", "pages_failed", "ads", "failed")) == [
        ("djinni", 0, 1, 0, True), ("remoteok", 1, 1, 3, False),
    ]
    tight = Profile(keywords=(Keyword("go", 4),), min_score=4, languages=("en", "de"), exclude_companies=("bad", "ugly"))
    assert start_up(store, PROFILE) == 0
    assert start_up(store, tight) == 2 and values(store.load(), "company") == ["Acme"]
    version = store.version()
    assert start_up(store, tight) == 0 and store.version() == version


def test_page_reports_of_threads_and_cards(spark):
    raw = spark.createDataFrame([("a", '{"id": 1, "children": []}', 0), ("b", "{broken", 1), ("c", None, 2)], "page_url string, body string, seq long")
    assert sorted(values(threads.thread_pages(raw), "page_url", "ok")) == [("a", True), ("b", False), ("c", False)]
    assert sorted(values(fetched_pages(raw, "djinni"), "source", "page_url", "ok")) == [
        ("djinni", "a", True), ("djinni", "b", True), ("djinni", "c", False),
    ]


def micro_batch_raw(spark, folder):
    from listsieve.sources.raw import read_raw

    return read_raw(spark, str(folder))


def test_run_with_enrichment_and_verification(spark, tmp_path):
    sources = Sources({"serper": Settings(queries=("q",)), "justjoin": Settings(pages=("p",))})
    link = '<div><h3><a class="offer_list_offer_title_link" href="{0}">Go {0}</a></h3><p>Acme</p></div>'

    def one(body):
        return spark.createDataFrame([("https://b.test/x", body, 0)], "page_url string, body string, seq long")

    hits = json.dumps({"organic": [{"title": "hit", "link": f"https://e.test/{i}", "snippet": "x"} for i in range(3)]})
    ads = sources.ingest(
        {"justjoin": one("".join(link.format(u) for u in ("j1", "j2", "j3"))), "serper": one(hits)}
    )
    pages = spark.createDataFrame(
        [("https://e.test/0", True, "All about <b>go</b>", "Go job"), ("https://e.test/1", True, "go go", ""),
         ("j1", True, "you and your team with skills", ""), ("j2", True, "oferujemy umowa wymagania praca oraz", "")],
        "url string, success boolean, markdown string, title string",
    )
    store = StateStore(spark, str(tmp_path / "state"), buckets=2)
    run = run_once(store, ads, PROFILE, T0, pages, {"justjoin": 2}, max_pages=1, batch="b0")
    assert sorted(values(store.load(), "url", "title", "hidden")) == [
        ("https://e.test/0", "Go job", False), ("j1", "Go j1", False), ("j2", "Go j2", True),
    ]
    assert sorted(values(run.fresh, "url")) == ["https://e.test/0", "j1"]
    assert sorted(values(run.metrics, "source", "fetched", "matched", "new")) == [("justjoin", 3, 3, 1), ("serper", 3, 1, 1)]
    assert values(run.verification, "fetched", "rejected") == [(2, 1)]
    assert sorted(values(store.load_crawled(), "url")) == ["https://e.test/0", "j1", "j2"]


def stream_of(spark, folder, *batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "id string, seen_at string, hidden boolean, status string")
        frame.coalesce(1).write.mode("append").json(str(folder / f"in={i}"))
    schema = "id string, seen_at timestamp, hidden boolean, status string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(f"{folder}/*")


def run_to_table(frame, folder, name, mode="append"):
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_keyed_state(spark, tmp_path):
    source = stream_of(
        spark,
        tmp_path / "in",
        [("a", "2026-01-01 00:00:00", False, None), ("t", "2026-01-01 00:00:00", False, "applied"), ("h", "2026-01-01 00:00:00", True, None)],
        [("a", "2026-01-02 00:00:00", True, None), ("a", None, False, None), ("o", "2026-02-02 00:00:00", False, None),
         ("o", "2026-02-01 00:00:00", False, None)],
        [("a", "2026-06-01 00:00:00", False, None), ("t", "2026-06-01 00:00:00", False, None)],
    )
    run_to_table(keyed_state.stateful_merge(source), tmp_path / "cp", "freshness")
    got = sorted(values(spark.table("freshness"), "id", "last_seen", "hidden", "status", "fresh"))
    day = dt.datetime
    assert got == [
        ("a", day(2026, 1, 1), False, "", True),
        ("a", day(2026, 1, 2), True, "", False),
        ("a", day(2026, 6, 1), False, "", True),  # forgotten in between
        ("h", day(2026, 1, 1), True, "", False),
        ("o", day(2026, 2, 2), False, "", True),  # both sightings of the trigger
        ("t", day(2026, 1, 1), False, "applied", True),
        ("t", day(2026, 6, 1), False, "applied", False),  # tracked, so remembered
    ]


def test_keyed_state_does_not_depend_on_order(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [
        (rng.choice("abcd"), f"2026-01-{rng.randint(1, 28):02} 00:00:0{rng.randint(0, 2)}", rng.random() < 0.3, rng.choice([None, None, "", "applied", "declined"]))
        for _ in range(300)
    ] + [("hot", f"2026-01-01 00:{i // 60 % 60:02}:{i % 60:02}", i == 5, None) for i in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    found = []
    for k in range(2):
        rng.shuffle(rows)
        source = stream_of(spark, tmp_path / f"in{k}", rows)
        run_to_table(keyed_state.stateful_merge(source), tmp_path / f"cp{k}", f"shuffled{k}")
        found.append(sorted(values(spark.table(f"shuffled{k}"), *keyed_state.OUTPUT.replace(",", "").split()[::2])))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0]) == 5
    for id_, first, last, hidden, status, fresh in found[0]:
        own = [(r[1], r[2], r[3]) for r in rows if r[0] == id_]
        told = max(((t, s) for t, _, s in own if s is not None), default=("", ""))
        times = [t for t, _, _ in own]
        assert (str(first), str(last)) == (min(times), max(times))
        assert (hidden, status) == (any(h for _, h, _ in own), told[1])
        assert fresh != any(h for t, h, _ in own if t == min(times))


def test_plain_values_say_what_collapsed_frames_say():
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        us, hidden = rng.randint(0, 20), rng.random() < 0.3
        status = rng.choice([None, None, "", "applied", "declined"])
        never = keyed_state._NEVER
        rows.append((rng.choice(["a", "b", "c", None]), us, us, hidden, hidden, status, never if status is None else us))
    rows += [("bare", 2**60 + 1, 2**60 + 1, False, False, None, keyed_state._NEVER)]
    seen = pd.DataFrame(rows, columns=keyed_state._NAMES)
    whole = keyed_state.collapse(seen).set_index("id")
    assert sorted(whole.index) == ["a", "b", "bare", "c"]  # none without an id
    for id_, own in seen.groupby("id"):
        one = keyed_state.Seen()
        for k in range(0, len(own), 7):
            one.take(keyed_state.collapse(own[k : k + 7]).astype({"status": object}).replace({"status": {float("nan"): None}}))
        first, last = own["first_us"].min(), own["last_us"].max()
        told = max(((us, s) for us, s in zip(own["status_us"], own["status"]) if s is not None), default=(keyed_state._NEVER, None))
        expected = (first, last, own[own["first_us"] == first]["first_hidden"].any(), own["hidden"].any(), told[1], told[0])
        assert (one.first_us, one.last_us, one.first_hidden, one.hidden, one.status, one.status_us) == expected
        got = whole.loc[id_]
        assert (got.first_us, got.last_us, got.first_hidden, got.hidden, got.status_us) == (*expected[:4], expected[5])
        assert got.status == told[1] or (pd.isna(got.status) and told[1] is None)
    nobody = keyed_state.collapse(seen[seen["id"].isna()])
    assert len(nobody) == 0 and list(nobody.columns) == keyed_state._NAMES


def test_keyed_state_drops_rows_without_an_id(spark, tmp_path):
    source = stream_of(
        spark, tmp_path / "in", [(None, "2026-01-01 00:00:00", False, "applied")],
        [(None, "2026-01-02 00:00:00", False, None), ("a", "2026-01-02 00:00:00", False, None)],
    )
    run_to_table(keyed_state.stateful_merge(source), tmp_path / "cp", "named")
    assert values(spark.table("named"), "id", "status", "fresh") == [("a", "", True)]


def test_first_sightings(spark, tmp_path):
    source = stream_of(
        spark, tmp_path / "in",
        [("u?ref=1", "2026-01-01 00:00:00", False, None)], [("u?ref=2", "2026-01-02 00:00:00", False, None)],
    )
    named = source.withColumnRenamed("id", "url").withColumn("source", F.lit("s"))
    run_to_table(seen.first_sightings(named), tmp_path / "cp", "sightings")
    assert values(spark.table("sightings"), "url") == ["u"]

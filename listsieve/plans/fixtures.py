"""The driver's tables, seen as listings.

Everything is derived from the given tables row by row, or in groups whose size
is fixed (a page of twenty listings), so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listsieve.plans.runtime import widen
from listsieve.profile import Bonus, Geography, Keyword, Profile

NOW = "2024-06-01 00:00:00"
PER_PAGE = 20

PROFILE = Profile(
    keywords=(
        Keyword("attion", 4),
        Keyword("thea", 3),
        Keyword("only", 2),
        Keyword("rely", 0),
        Keyword("les", 2),
        Keyword("the,", 1),
        Keyword("worthless", -2),
        Keyword("die", 2),
    ),
    min_score=4,
    title_boost=("the", "attion", "un"),
    title_boost_weight=2,
    exclude=("nicht", "oredble"),
    exclude_companies=("CO 1",),
    require_any=("the", "und", "erin", "de"),
    core_title_terms=("the", "erin", "des"),
    adjacent_titles=("in", "la"),
    languages=("en", "fr"),
    bonuses=(Bonus(("ering", "est"), 1, "either"), Bonus(("pour", "sch"), 0), Bonus(())),
    geography=Geography(
        local_label="home",
        remote_label="away",
        local_markers=("europe", "thanedble"),
        region_markers=("asia", "anything", "attion"),
        reject_markers=("africa", "onon"),
    ),
)


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def base_key() -> Column:
    """A fifth of all documents repeat the listing twenty before."""
    repeat = F.col("doc_id") % 100 >= 80
    return F.when(repeat, F.col("doc_id") - 20).otherwise(F.col("doc_id"))


def ad_url() -> Column:
    key = F.col("key").cast("string")
    return F.concat(
        F.lit("https://jobs.example.com/ad/"), key, F.lit("?id="), key,
        F.lit("&utm_source="), F.col("doc_id").cast("string"),
    )


def first_line(text: str = "text") -> Column:
    return F.substring(F.regexp_extract(text, r"^[^.\n]*", 0), 1, 140)


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as ads; ``seq`` is the arrival order."""
    docs = table(spark, sf_dir, "documents").withColumn("key", base_key())
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("region"), F.col("r_name").alias("location")
    )
    return (
        docs.withColumn("region", F.col("doc_id") % 5)
        .join(region, "region", "left")
        .select(
            "doc_id",
            F.col("doc_id").alias("seq"),
            "source",
            first_line().alias("title"),
            F.concat(F.lit("Co "), (F.col("doc_id") % 40).cast("string")).alias("company"),
            F.coalesce("location", F.lit("")).alias("location"),
            ad_url().alias("url"),
            F.array("lang", "source").alias("tags"),
            F.col("text").alias("description"),
            (F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)).alias("posted_at"),
        )
    )


def ranked_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads with a score and fit that cost nothing, for the state operators."""
    return ads(spark, sf_dir).withColumns(
        {
            "score": (F.col("doc_id") % 17 - 3).cast("int"),
            "reasons": F.col("tags"),
            "fit": F.when(F.col("doc_id") % 4 == 0, "home (europe)")
            .when(F.col("doc_id") % 4 == 1, "away")
            .when(F.col("doc_id") % 4 == 2, "away (unverified)")
            .otherwise(""),
        }
    )


def _seen(minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - minutes * 60)


def state(spark: SparkSession, sf_dir: str, before_batch: bool = False) -> DataFrame:
    """Stored state: the listings of all documents that are no repeats. ``before_batch``
    leaves those out that only ``batch`` brings: remainders from 6 of 10 on."""
    from listsieve import schema as sc
    from listsieve.operators.merge import identify

    stored = ranked_ads(spark, sf_dir).filter(F.col("doc_id") % 100 < 80)
    if before_batch:
        stored = stored.filter(F.col("doc_id") % 10 < 6)
    age = (F.col("doc_id") * 137) % 200_000  # minutes, up to 138 days
    status = (
        F.when(F.col("doc_id") % 13 == 0, "applied")
        .when(F.col("doc_id") % 29 == 0, "declined")
        .otherwise("")
    )
    rows = stored.withColumns(
        {
            "hidden": F.col("doc_id") % 7 == 0,
            "status": status,
            "status_at": F.when(status != "", _seen(age)),
            "first_seen": _seen(age + 1440),
            "last_seen": _seen(age),
        }
    )
    return sc.conform(identify(rows), sc.STATE)


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming batch: all repeats and every document numbered 4 to 9 of 10, some of them
    hidden. Together with the state before it, it holds every document."""
    incoming = ranked_ads(spark, sf_dir).filter((F.col("doc_id") % 10 >= 4) | (F.col("doc_id") % 100 >= 80))
    return incoming.withColumn("hidden", F.col("doc_id") % 11 == 0)


# ---- Crawl cache and fetched pages ----------------------------------------------


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries for every third page's ad, up to 50 days old."""
    pages = table(spark, sf_dir, "pages").filter(F.col("page_id") % 3 == 0)
    keyed = pages.withColumn("doc_id", F.col("page_id")).withColumn("key", base_key())
    return keyed.select(
        ad_url().alias("url"), _seen((F.col("page_id") % 50) * 1440).alias("crawled_at")
    )


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as fetch results for the ad of the same number; one in seven failed."""
    keyed = (
        table(spark, sf_dir, "pages").withColumn("doc_id", F.col("page_id")).withColumn("key", base_key())
    )
    return keyed.select(
        ad_url().alias("url"),
        (F.col("page_id") % 7 != 0).alias("success"),
        F.col("html").alias("markdown"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.lit("").alias("error"),
    )


# ---- Events ----------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as labels (view, click), items (purchase) and notes (the rest)."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "label")
        .when(F.col("event_type") == "purchase", "item")
        .otherwise("note")
    )
    item = (F.floor("value") % 5).cast("string")
    note_key = F.when(F.col("event_id") % 3 == 0, item).otherwise("")
    company = F.when(F.col("event_id") % 11 == 0, "").otherwise(
        F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))
    )
    return e.select(
        "user_id",
        F.struct("ts", "event_id").alias("pos"),
        F.to_date("ts").alias("day"),
        kind.alias("kind"),
        F.when(kind == "item", item).when(kind == "note", note_key).otherwise("").alias("key"),
        F.when(kind == "label", F.concat("event_type", F.floor("value") % 4))
        .when(kind == "item", F.col("props"))
        .otherwise(company)
        .alias("value"),
    )


# ---- Documents written out in the feeds' formats, twenty to a page ----------------


def _pages_of(spark: SparkSession, sf_dir: str, item: Column, glue: str, around) -> DataFrame:
    """Raw pages: the items of each run of twenty documents, joined and wrapped."""
    docs = table(spark, sf_dir, "documents")
    page = F.floor(F.col("doc_id") / PER_PAGE)
    items = docs.select(page.alias("seq"), "doc_id", item.alias("item"))
    grouped = items.groupBy("seq").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "item")))["item"].alias("items")
    )
    return grouped.select(
        F.concat(F.lit("https://board.example.com/jobs/page-"), F.col("seq").cast("string"), F.lit("/")).alias(
            "page_url"
        ),
        around(F.array_join("items", glue)).alias("body"),
        F.col("seq").cast("long").alias("seq"),
    )


def _wrapped(before: str, after: str):
    return lambda inner: F.concat(F.lit(before), inner, F.lit(after))


def _number() -> Column:
    return F.col("doc_id").cast("string")


def _iso(zone: str) -> Column:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def link_key() -> Column:
    return base_key().cast("string")


def flat_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 9 == 0, "").otherwise(first_line())
    item = F.to_json(
        F.struct(
            title.alias("position"),
            F.col("source").alias("company"),
            F.array("lang").alias("tags"),
            F.col("lang").alias("location"),
            F.concat(F.lit("https://a.example.com/"), link_key()).alias("url"),
            F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("description"),
            _iso("Z").alias("date"),
        )
    )
    return _pages_of(spark, sf_dir, item, ",", _wrapped('[{"legal":"notice"},', "]"))


def nested_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.to_json(
        F.struct(
            F.concat(F.lit("https://b.example.com/"), link_key()).alias("url"),
            first_line().alias("title"),
            F.col("source").alias("company_name"),
            F.when(F.col("doc_id") % 2 == 0, "full_time").otherwise("").alias("job_type"),
            F.col("lang").alias("candidate_required_location"),
            F.when(F.col("doc_id") % 6 == 0, "soon").otherwise(_iso("")).alias("publication_date"),
            F.col("text").alias("description"),
            F.array("lang", "source").alias("tags"),
        )
    )
    return _pages_of(spark, sf_dir, item, ",", _wrapped('{"jobs":[', "]}"))


def _markup(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    item = F.concat(
        F.lit("<item><title>"), F.col("source"), F.lit(": "), _markup(first_line()),
        F.lit("</title><link>https://c.example.com/"), link_key(),
        F.lit("</link><region>Any &amp;amp; "), F.col("lang"),
        F.lit("</region><description>"), _markup(F.col("text")),
        F.lit("</description><pubDate>Mon, "), F.date_format(at, "dd MMM yyyy HH:mm:ss"),
        F.lit(" +0000</pubDate></item>"),
    )
    return _pages_of(spark, sf_dir, item, "", _wrapped("<rss><channel><title>t</title>", "</channel></rss>"))


COUNTRY_SETS = [[], ["US"], ["US", "de"], ["bg", "US"], ["GB", "CA"]]


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.array(*[F.array(*[F.lit(c) for c in s]).cast("array<string>") for s in COUNTRY_SETS])
    item = F.to_json(
        F.struct(
            _number().alias("randomKey"),
            first_line().alias("title"),
            F.when(F.col("doc_id") % 2 == 0, "permanent").otherwise("").alias("jobType"),
            F.element_at(sets, (F.col("doc_id") % 5 + 1).cast("int")).alias("requiredCountries"),
            F.array("lang").alias("experienceLevels"),
            F.concat(F.lit("ad-"), link_key()).alias("urlString"),
            F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.lit(1704067200) + F.col("doc_id") * 60).alias("postedAt"),
            F.struct(F.col("source").alias("name")).alias("company"),
            F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 18 + 1).cast("int")),
                        lambda i: F.struct(F.concat(F.lit("c"), i).alias("name"))).alias("categories"),
        )
    )
    start = '<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"externalJobs":['
    return _pages_of(spark, sf_dir, item, ",", _wrapped(start, "]}}}</script></html>"))


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.array(*[F.lit(h) for h in ("www.acme.test", "uk.indeed.com", "dropbox.com", "Jobs.Acme.test:8080")])
    link = F.concat(
        F.lit("https://"), F.element_at(hosts, (F.col("doc_id") % 4 + 1).cast("int")), F.lit("/"), link_key()
    )
    item = F.to_json(
        F.struct(
            first_line().alias("title"),
            F.when(F.col("doc_id") % 15 == 0, "").otherwise(link).alias("link"),
            F.col("text").alias("snippet"),
        )
    )
    return _pages_of(spark, sf_dir, item, ",", _wrapped('{"organic":[', "]}"))


def full_card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    item = F.concat(
        F.lit('<div class="job-item card"><a class="job_item__header-link x" href="/jobs/'), link_key(),
        F.lit('"><header><h2 class="job-item__position"> '), _markup(first_line()),
        F.lit(' </h2><span class="small">'), F.col("source"),
        F.lit('</span><span title="no stamp">$</span></header></a><span>'),
        F.when(F.col("doc_id") % 2 == 0, "Full Remote").otherwise("Office Work"),
        F.lit('</span><span class="location-text">'),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")),
        F.lit('</span><div class="job-item__tags"><span class="badge a">'), F.col("lang"),
        F.lit('</span><span class="badge">'), F.col("source"),
        F.lit('</span><span class="badge">'), F.col("lang"),
        F.lit('</span></div><span class="badge">no tag</span><span class="js-truncated-text">cut '),
        F.col("source"), F.lit("</span>"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(
            F.concat(F.lit('<span class="js-original-text"><p>'), _markup(_markup(F.col("text"))), F.lit("</p></span>"))
        ),
        F.lit('<span title="'), F.date_format(at, "HH:mm dd.MM.yyyy"), F.lit('">1m</span></div>'),
    )
    return _pages_of(spark, sf_dir, item, "\n", _wrapped("<html><body><ul>", "</ul></body></html>"))


def title_card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    badge = F.when(F.col("doc_id") % 3 == 0, "badge remote").when(F.col("doc_id") % 3 == 1, "badge hybrid").otherwise("badge")
    item = F.concat(
        F.lit('<div class="job-list-item"><a class="overlay-link" href="https://dev.bg/ad/'), link_key(),
        F.lit('"></a><h6 class="job-title">'), _markup(first_line()),
        F.lit('</h6><span class="company-name"> '), F.col("source"),
        F.lit(' </span><span class="'), badge, F.lit('">b</span></div>'),
    )
    return _pages_of(spark, sf_dir, item, "\n", _wrapped("<html><body>", "</body></html>"))


def link_card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(
        F.lit('<section><div><h3><a class="offer_list_offer_title_link" href="https://d.example.com/'),
        link_key(), F.lit('">'), _markup(first_line()),
        F.lit('</a></h3></div><div><div><p>'),
        F.when(F.col("doc_id") % 5 == 0, "Remote").otherwise(F.col("source")),
        F.lit("</p></div>"),
        F.when(F.col("doc_id") % 2 == 0, "<p>Remote</p>").otherwise(""),
        F.lit("<div>New</div><div>"), F.col("lang"), F.lit("</div><span>12 000 - 15 000</span><span>"),
        F.col("source"), F.lit("</span><span>"), F.col("lang"),
        F.lit("</span><div><span>nested</span></div><span>3d left</span></div></section>"),
    )
    return _pages_of(spark, sf_dir, item, "\n", _wrapped("<html><body>", "</body></html>"))


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.replace(F.replace(first_line(), F.lit('"'), F.lit("")), F.lit(")"), F.lit(""))
    number = (base_key() + 1000).cast("string")
    company = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("?job="), number)).otherwise("")
    item = F.concat(
        F.lit("[!["), F.col("lang"), F.lit("](https://static.jobs.bg/mobile/images/skills/x.png)\n![s"),
        (F.col("doc_id") % 3).cast("string"), F.lit("](https://static.tech.bg/mobile/images/skills/y.png)]"),
        F.lit("(https://www.jobs.bg/job/"), number, F.lit(' "t '), title, F.lit('")\n'),
        F.lit("[c](https://www.jobs.bg/company/acme-1"), company, F.lit(' "'), F.col("source"), F.lit('")\n'),
    )
    return _pages_of(spark, sf_dir, item, "\n", _wrapped("# jobs\n", ""))


def posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document with up to three metadata scripts."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, "Article").otherwise("JobPosting")
    posting = F.to_json(F.struct(kind.alias("@type"), F.col("text").alias("description")))
    body = F.concat(
        F.lit('<script type="application/ld+json">{broken</script>'),
        F.lit('<script type="application/ld+json">{"@type":"JobPosting","description":""}</script>'),
        F.lit('<script type="application/ld+json">'), posting, F.lit("</script>"),
    )
    return docs.select(
        F.concat(F.lit("https://e.example.com/"), _number()).alias("page_url"),
        body.alias("body"),
        F.col("doc_id").alias("seq"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as replies of one long thread."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.lit("thread").alias("page_url"),
        F.col("conv_id").alias("seq"),
        F.col("turn").cast("int").alias("pos"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"),
        F.concat("role", F.lit(" | "), "text").alias("text"),
        F.when(F.col("turn") == 0, "2024-02-03T04:05:06.000Z").otherwise("yesterday").alias("created_at"),
    )


def thread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as raw JSON: twenty turns of a conversation to a response."""
    reply = F.struct(F.col("post_id").alias("id"), "text", "created_at")
    pages = posts(spark, sf_dir).withColumn("part", F.floor(F.col("pos") / PER_PAGE))
    grouped = pages.groupBy("seq", "part").agg(F.array_sort(F.collect_list(F.struct("pos", reply.alias("reply")))).alias("replies"))
    body = F.struct(F.col("seq").alias("id"), F.lit("thread").alias("text"), F.col("replies.reply").alias("children"))
    return grouped.select(F.concat_ws("-", "seq", "part").alias("page_url"), F.to_json(body).alias("body"), "seq")


def thread_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as thread search responses."""
    hit = F.to_json(F.struct(_number().alias("objectID"), first_line().alias("title")))
    return _pages_of(spark, sf_dir, hit, ",", _wrapped('{"hits":[', "]}"))


def state_objects(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """(part, line): the state as JSON objects of entries by id, one object a part. Tracked rows
    are written the old way, with a flag in place of the status "applied"."""
    rows = state(spark, sf_dir).withColumn("part", F.expr(f"pmod(hash(id), {parts})"))
    old = F.col("status") == "applied"
    columns = [
        F.when(~old, F.col(c)).alias(c) if c in ("status", "status_at") else F.col(c) for c in rows.columns if c != "part"
    ]
    entry = F.to_json(F.struct(*columns, F.when(old, True).alias("applied"), F.when(old, F.col("status_at")).alias("applied_at")))
    first = F.row_number().over(Window.partitionBy("part").orderBy("id")) == 1
    comma = F.when(first, "").otherwise(",")
    entries = rows.select("part", F.lit(1).alias("ord"), "id", F.concat(comma, F.lit('"'), "id", F.lit('":'), entry).alias("line"))
    ends = [rows.select("part", F.lit(n).alias("ord"), F.lit("").alias("id"), F.lit(mark).alias("line")).distinct() for n, mark in ((0, "{"), (2, "}"))]
    every = entries.unionByName(ends[0]).unionByName(ends[1])
    return every.repartition(parts, "part").sortWithinPartitions("part", "ord", "id").select("part", "line")

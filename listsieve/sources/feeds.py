"""JSON and RSS feeds to ads. Input is the raw table, one response per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.functions import dates
from listsieve.functions.text import split_company_title, strip_html, truncate
from listsieve.operators.dedupe import first_wins
from listsieve.sources.raw import CORRUPT, finish, is_bad, parse_json, parse_json_array, present

FEED_DESCRIPTION_BYTES = 2000  # of a description; ``max_bytes=None`` keeps all of it

# ---- Fixed values: the feeds' field names ------------------------------------
FLAT_FEED_ITEM = (
    "struct<slug: string, position: string, company: string, tags: array<string>, "
    "location: string, url: string, description: string, date: string>"
)
NESTED_FEED = (
    "jobs array<struct<url: string, title: string, company_name: string, job_type: string, "
    "candidate_required_location: string, publication_date: string, description: string, "
    "tags: array<string>>>"
)
RSS_FEED = (
    "channel struct<item: array<struct<title: string, link: string, region: string, "
    "description: string, pubDate: string>>>"
)
# --------------------------------------------------------------------------------


def _text(name: str):
    return F.coalesce(F.col(f"col.{name}"), F.lit(""))


def _explode(parsed: DataFrame, items: str) -> DataFrame:
    return parsed.select("page_url", "seq", F.posexplode(items)).filter(F.col("col").isNotNull())


def read_json_feed(
    raw: DataFrame, name: str = "remoteok", max_bytes: int | None = FEED_DESCRIPTION_BYTES
) -> DataFrame:
    """A flat JSON array. Elements without title or URL, such as the notice at the
    start, are dropped; repeated URLs are not."""
    parsed = _json_array(raw)
    items = _explode(parsed.filter(~is_bad("r")), "r.items")
    return present(
        finish(
            items,
            name,
            {
                "title": _text("position"),
                "company": _text("company"),
                "location": _text("location"),
                "url": _text("url"),
                "tags": F.col("col.tags"),
                "description": truncate(strip_html(_text("description")), max_bytes),
                "posted_at": dates.parse_rfc3339(F.col("col.date")),
            },
        )
    )


def _json_array(raw: DataFrame) -> DataFrame:
    return raw.withColumn("r", parse_json_array(F.col("body"), FLAT_FEED_ITEM))


def json_feed_pages(raw: DataFrame, name: str = "remoteok") -> DataFrame:
    return _pages(_json_array(raw), name, ~is_bad("r"))


def _pages(parsed: DataFrame, name: str, ok) -> DataFrame:
    return parsed.select(F.lit(name).alias("source"), "page_url", ok.alias("ok"))


def read_nested_json_feed(
    raw: DataFrame, name: str = "remotive", max_bytes: int | None = FEED_DESCRIPTION_BYTES
) -> DataFrame:
    """``{"jobs": [...]}`` per category; the job type is one more tag."""
    parsed = raw.withColumn("r", parse_json("body", NESTED_FEED))
    items = _explode(parsed.filter(~is_bad("r")), "r.jobs")
    tags = F.coalesce(F.col("col.tags"), F.array().cast("array<string>"))
    kind = _text("job_type")
    ads = finish(
        items,
        name,
        {
            "title": _text("title"),
            "company": _text("company_name"),
            "location": _text("candidate_required_location"),
            "url": _text("url"),
            "tags": F.when(kind == "", tags).otherwise(F.concat(tags, F.array(kind))),
            "description": truncate(strip_html(_text("description")), max_bytes),
            "posted_at": dates.parse_zoneless(F.col("col.publication_date")),
        },
    )
    return first_wins(ads)


def nested_json_feed_pages(raw: DataFrame, name: str = "remotive") -> DataFrame:
    parsed = raw.withColumn("r", parse_json("body", NESTED_FEED))
    return _pages(parsed, name, ~is_bad("r"))


def _rss(raw: DataFrame) -> DataFrame:
    shape = f"{RSS_FEED}, {CORRUPT} string"
    return raw.withColumn(
        "r", F.from_xml("body", shape, {"columnNameOfCorruptRecord": CORRUPT})
    )


def read_rss(
    raw: DataFrame, name: str = "weworkremotely", max_bytes: int | None = FEED_DESCRIPTION_BYTES
) -> DataFrame:
    """RSS items titled "Company: Role"."""
    items = _explode(_rss(raw).filter(~is_bad("r")), "r.channel.item")
    company, title = split_company_title(_text("title"))
    ads = finish(
        items,
        name,
        {
            "title": title,
            "company": company,
            "location": strip_html(_text("region")),
            "url": _text("link"),
            "description": truncate(strip_html(_text("description")), max_bytes),
            "posted_at": dates.parse_rfc1123z(F.col("col.pubDate")),
        },
    )
    return first_wins(ads)


def rss_pages(raw: DataFrame, name: str = "weworkremotely") -> DataFrame:
    return _pages(_rss(raw), name, ~is_bad("r"))

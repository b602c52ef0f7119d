"""JSON embedded in HTML pages: listing data and job-posting metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.functions import dates
from listsieve.functions.text import cap_array, countries_to_location, strip_html, truncate
from listsieve.operators.dedupe import first_wins
from listsieve.sources.raw import finish, is_bad, parse_json, present

# ---- Fixed values -----------------------------------------------------------
EMBEDDED_SCRIPT = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
EMBEDDED_SHAPE = (
    "props struct<pageProps: struct<externalJobs: array<struct<randomKey: string, "
    "title: string, jobType: string, requiredCountries: array<string>, "
    "experienceLevels: array<string>, urlString: string, postedAt: bigint, "
    "company: struct<name: string>, categories: array<struct<name: string>>>>>>"
)
EMBEDDED_URL = "https://arc.dev/remote-jobs/j/"
POSTING_SCRIPT = r'(?s)<script type="application/ld\+json">(.*?)</script>'
POSTING_SHAPE = "struct<`@type`: string, description: string>"
POSTING_TYPE = "JobPosting"
MAX_CATEGORIES = 15
POSTING_BYTES = 3000
# -----------------------------------------------------------------------------


def _parsed(raw: DataFrame) -> DataFrame:
    script = F.regexp_extract("body", EMBEDDED_SCRIPT, 1)
    return raw.withColumn("r", parse_json(F.when(script != "", script), EMBEDDED_SHAPE))


def embedded_pages(raw: DataFrame, name: str = "arcdev") -> DataFrame:
    return _parsed(raw).select(F.lit(name).alias("source"), "page_url", (~is_bad("r")).alias("ok"))


def read_embedded_json(
    raw: DataFrame, name: str = "arcdev", max_categories: int | None = MAX_CATEGORIES
) -> DataFrame:
    """Listings from the page's data script that the hiring area can apply to."""
    parsed = _parsed(raw).filter(~is_bad("r"))
    items = parsed.select("page_url", "seq", F.posexplode("r.props.pageProps.externalJobs"))
    items = items.filter(F.col("col").isNotNull())

    def text(field: str) -> Column:
        return F.coalesce(F.col(f"col.{field}"), F.lit(""))

    def texts(value: Column) -> Column:
        return F.coalesce(value, F.array().cast("array<string>"))

    items = items.withColumn("place", countries_to_location("col.requiredCountries")).filter(
        F.col("place").isNotNull() & (text("title") != "") & (text("urlString") != "")
    )
    names = F.transform(F.col("col.categories.name"), lambda n: F.coalesce(n, F.lit("")))
    kind = text("jobType")
    tags = F.concat(
        cap_array(texts(names), max_categories),
        texts(F.col("col.experienceLevels")),
        F.when(kind != "", F.array(kind)).otherwise(F.array().cast("array<string>")),
    )
    items = items.withColumn("tags", tags)
    ads = finish(
        items,
        name,
        {
            "title": text("title"),
            "company": text("company.name"),
            "location": F.col("place"),
            "url": F.concat(F.lit(EMBEDDED_URL), text("urlString"), F.lit("-"), text("randomKey")),
            "tags": F.col("tags"),
            "description": F.array_join("tags", " "),
            "posted_at": dates.parse_epoch(F.col("col.postedAt")),
        },
    )
    return first_wins(present(ads))


def posting_description(body) -> Column:
    """Text of the first job posting in the page's JSON-LD; NULL when missing."""
    scripts = F.regexp_extract_all(body, F.lit(POSTING_SCRIPT), F.lit(1))
    parsed = F.transform(scripts, lambda s: F.from_json(s, POSTING_SHAPE))
    postings = F.filter(
        parsed, lambda p: (p["@type"] == POSTING_TYPE) & (F.coalesce(p["description"], F.lit("")) != "")
    )
    return F.try_element_at(postings, F.lit(1))["description"]


def extract_jsonld(pages: DataFrame, max_bytes: int | None = POSTING_BYTES) -> DataFrame:
    """``(page_url, found, description)`` per page; at most ``max_bytes`` of a text, None: all."""
    named = pages.select("page_url", posting_description("body").alias("raw_text"))
    return named.select(
        "page_url",
        F.col("raw_text").isNotNull().alias("found"),
        F.when(F.col("raw_text").isNotNull(), truncate(strip_html("raw_text"), max_bytes)).alias(
            "description"
        ),
    )


def posting_results(raw: DataFrame, max_bytes: int | None = POSTING_BYTES) -> DataFrame:
    """Offer pages as page results: the text to verify is the posting's."""
    found = extract_jsonld(raw, max_bytes)
    return found.select(
        F.col("page_url").alias("url"),
        F.col("found").alias("success"),
        F.coalesce("description", F.lit("")).alias("markdown"),
        F.lit("").alias("title"),
        F.when(~F.col("found"), "no job posting on the page").otherwise("").alias("error"),
    )

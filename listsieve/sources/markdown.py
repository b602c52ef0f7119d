"""Listing pages rendered as markdown: an ordered stream of links and icons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.functions.text import trim_space
from listsieve.operators.attribution import attribute_events
from listsieve.operators.dedupe import first_wins
from listsieve.sources.raw import finish

# ---- Fixed values: what the links look like ----------------------------------
SKILL = r"!\[([^\]]+)\]\(https://static\.(?:jobs|tech)\.bg/mobile/images/skills/"
JOB = r'\]\(https://www\.(?:jobs|tech)\.bg/job/(\d+)[^)]*?"([^"]+)"\)'
COMPANY = (
    r'\(https://www\.(?:jobs|tech)\.bg/company/[\w-]+(?:\?job=(\d+))?[^)]*?"([^"]+)"\)'
)
JOB_URL = "https://www.jobs.bg/en/job/"
JOB_LOCATION = "Bulgaria"
# --------------------------------------------------------------------------------


def markdown_events(raw: DataFrame) -> DataFrame:
    """Skills, job links and company links of a page, numbered as they occur.

    One pattern with three branches finds them all in document order; which one
    it was shows in the matched text. No two branches can start alike.
    """
    anywhere = f"{SKILL}|{JOB}|{COMPANY}"
    found = raw.select(
        "page_url", "seq", F.posexplode(F.regexp_extract_all("body", F.lit(anywhere), F.lit(0)))
    )
    kind = (
        F.when(F.startswith("col", F.lit("!")), "label")
        .when(F.startswith("col", F.lit("]")), "item")
        .otherwise("note")
    )
    key = F.when(kind == "item", F.regexp_extract("col", JOB, 1)).when(
        kind == "note", F.regexp_extract("col", COMPANY, 1)
    )
    value = (
        F.when(kind == "label", F.regexp_extract("col", SKILL, 1))
        .when(kind == "item", trim_space(F.regexp_extract("col", JOB, 2)))
        .otherwise(trim_space(F.regexp_extract("col", COMPANY, 2)))
    )
    return found.select(
        F.struct("seq", "page_url").alias("page"),
        "pos",
        kind.alias("kind"),
        F.coalesce(key, F.lit("")).alias("key"),
        value.alias("value"),
    )


def read_markdown(raw: DataFrame, name: str = "jobsbg") -> DataFrame:
    """Markdown pages to ads; a page is one fetched response, so one chunk."""
    jobs = attribute_events(markdown_events(raw), part="page", order="pos")
    items = jobs.select("page.seq", "page.page_url", F.col("first_pos").alias("pos"),
                        "key", "title", "company", "tags")
    ads = finish(
        items,
        name,
        {
            "title": F.col("title"),
            "company": F.col("company"),
            "location": F.lit(JOB_LOCATION),
            "url": F.concat(F.lit(JOB_URL), F.col("key")),
            "tags": F.col("tags"),
            "description": F.array_join("tags", " "),
        },
    )
    return first_wins(ads)


def markdown_raw(pages: DataFrame) -> DataFrame:
    """Successful page results as raw rows, in order of URL."""
    return pages.filter("success").select(
        F.col("url").alias("page_url"), F.col("markdown").alias("body"), F.lit(0).cast("long").alias("seq")
    )

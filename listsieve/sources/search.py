"""Web search hits to ads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.functions.urls import bare_host
from listsieve.operators.dedupe import first_wins
from listsieve.operators.lookup import ALWAYS_SKIP, skip_domains
from listsieve.sources.raw import finish, is_bad, parse_json

# ---- Fixed values -----------------------------------------------------------
SEARCH_RESPONSE = "organic array<struct<title: string, link: string, snippet: string>>"
# -----------------------------------------------------------------------------


def search_pages(raw: DataFrame, name: str = "serper") -> DataFrame:
    parsed = raw.withColumn("r", parse_json("body", SEARCH_RESPONSE))
    return parsed.select(F.lit(name).alias("source"), "page_url", (~is_bad("r")).alias("ok"))


def hits_to_ads(raw: DataFrame, domains=tuple(ALWAYS_SKIP), name: str = "serper") -> DataFrame:
    """Hits with a link outside the skipped domains; the host stands in for the company."""
    parsed = raw.withColumn("r", parse_json("body", SEARCH_RESPONSE)).filter(~is_bad("r"))
    items = parsed.select("page_url", "seq", F.posexplode("r.organic"))
    items = items.filter(F.col("col").isNotNull())
    ads = finish(
        items,
        name,
        {
            "title": F.col("col.title"),
            "company": bare_host(F.col("col.link")),
            "url": F.col("col.link"),
            "description": F.col("col.snippet"),
        },
    )
    return first_wins(skip_domains(ads.filter(F.col("url") != ""), domains))

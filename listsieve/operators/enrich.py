"""Budgeted enrichment: re-reading pages for ads, at most so many per run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.functions import lexicon as lx
from listsieve.functions.language import language_excluded
from listsieve.functions.text import strip_html, truncate
from listsieve.operators.budget import budget
from listsieve.operators.lookup import CACHE_DAYS, as_time, flag_crawled
from listsieve.profile import Profile

DESCRIPTION_BYTES = 4000
TITLE_BYTES = 140
VERIFY_LIMIT = 25  # default budget per verified source
MAX_PAGES = 10  # default budget for search hits
BROADCAST_ROWS = 10_000  # rows of at most a page's cut text each


class Enriched(NamedTuple):
    ads: DataFrame
    crawled: DataFrame  # cache rows to add
    metrics: DataFrame | None = None


def _few(df: DataFrame, rows: int, cut: bool = True) -> DataFrame:
    """Broadcast rows whose number the budget bounds, unless the budget is large or texts are whole."""
    return F.broadcast(df) if cut and rows <= BROADCAST_ROWS else df


def _fetched(picked: DataFrame, pages: DataFrame, at_most: int) -> DataFrame:
    """Picked rows with ``page_text, page_title, got``, one page per URL.

    ``picked`` holds at most the budget, so the page table is cut down to the
    picked URLs where it is scanned; the text of all other pages never moves.
    """
    wanted = pages.join(_few(picked.select("url").distinct(), at_most), "url", "left_semi")
    page = wanted.groupBy("url").agg(
        F.max_by(
            F.struct(
                F.coalesce("markdown", F.lit("")).alias("text"),
                F.coalesce("title", F.lit("")).alias("title"),
                F.coalesce("success", F.lit(False)).alias("success"),
            ),
            F.struct(F.coalesce("success", F.lit(False)), "markdown", "title"),
        ).alias("__page")
    )
    return (
        picked.join(page, "url", "left")
        .withColumns(
            {
                "page_text": F.col("__page.text"),
                "page_title": F.col("__page.title"),
                "got": F.coalesce(F.col("__page.success"), F.lit(False)),
            }
        )
        .drop("__page")
    )


def _cache_rows(fetched: DataFrame, now) -> DataFrame:
    return fetched.filter("got").select("url", as_time(now).alias("crawled_at")).distinct()


def verify(
    ads: DataFrame,
    pages: DataFrame,
    crawled: DataFrame,
    limits: dict[str, int],
    profile: Profile,
    now,
    lexicon: lx.Lexicon = lx.DEFAULT_LEXICON,
    order: str = "arrival",
) -> Enriched:
    """Re-read the page of ads from sources with a limit, to judge its language.

    Cached ads and other sources pass unchanged. Ads beyond the budget, or whose
    page is missing, are left out of this run. URLs are expected to be unique
    within a source, as ``first_wins`` leaves them. A page in a foreign language makes
    its ad a hidden tombstone; any other page's text becomes the description.
    ``pages`` needs the text to store in ``markdown``. Scores stay as they are.
    """
    profile.checked(lexicon)
    limits = {name: k for name, k in limits.items() if k > 0}
    if "hidden" not in ads.columns:
        ads = ads.withColumn("hidden", F.lit(False))
    columns = ads.columns
    if not limits:
        none = ads.select("url").limit(0).withColumn("crawled_at", as_time(now))
        return Enriched(ads, none, None)
    under_limit = F.col("source").isin(*limits)
    flagged = flag_crawled(ads.filter(under_limit), crawled, now)
    passing = ads.filter(~under_limit).unionByName(flagged.filter("cached").select(*columns))

    waiting = flagged.filter(~F.col("cached")).select(*columns)
    picked = budget(waiting, max(limits.values()), "source", order, own=_limit_of(limits))
    fetched = _fetched(picked, pages, sum(limits.values())).withColumn(
        "foreign", language_excluded("title", "page_text", profile.languages, lexicon)
    )
    verified = (
        fetched.filter("got")
        .withColumns(
            {
                "description": F.when(F.col("foreign"), F.col("description")).otherwise(
                    F.col("page_text")
                ),
                "hidden": F.col("hidden") | F.col("foreign"),
            }
        )
        .select(*columns)
    )
    metrics = fetched.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(F.col("got") & F.col("foreign")).alias("rejected"),
    )
    return Enriched(passing.unionByName(verified), _cache_rows(fetched, now), metrics)


def _limit_of(limits: dict[str, int]):
    value = None
    for name, k in limits.items():
        test = F.col("source") == name
        value = F.when(test, k) if value is None else value.when(test, k)
    return value


def enrich(
    hits: DataFrame,
    pages: DataFrame,
    crawled: DataFrame,
    now,
    max_pages: int = MAX_PAGES,
    order: str = "arrival",
    max_bytes: int | None = DESCRIPTION_BYTES,
) -> Enriched:
    """Replace the snippets of the first ``max_pages`` uncached hits by page text, of which at
    most ``max_bytes`` are kept (None: all).

    Only those hits are looked up; the rest of the batch passes through a join
    against at most ``max_pages`` rows.
    """
    flagged = flag_crawled(hits, crawled, now)
    waiting = flagged.filter(~F.col("cached")).select("url", order)
    picked = budget(waiting, max_pages, None, order)
    fetched = _fetched(picked, pages, max_pages)
    text = truncate(strip_html("page_text"), max_bytes)
    new = fetched.filter("got").select(
        F.col(order),
        F.col("url"),
        text.alias("__text"),
        truncate("page_title", TITLE_BYTES).alias("__title"),
    )
    joined = hits.join(_few(new, max_pages, max_bytes is not None), ["url", order], "left")
    enriched = joined.withColumns(
        {
            "description": F.coalesce("__text", "description"),
            "title": F.when(F.coalesce("__title", F.lit("")) != "", F.col("__title")).otherwise(
                F.col("title")
            ),
        }
    ).select(*hits.columns)
    return Enriched(enriched, _cache_rows(fetched, now))


def update_crawled(crawled: DataFrame, new: DataFrame, now, days: int = CACHE_DAYS) -> DataFrame:
    """Newest time per URL; entries more than ``days`` days old go."""
    both = crawled.select("url", "crawled_at").unionByName(new.select("url", "crawled_at"))
    return unexpired(both, now, days).groupBy("url").agg(F.max("crawled_at").alias("crawled_at"))


def unexpired(crawled: DataFrame, now, days: int = CACHE_DAYS) -> DataFrame:
    """Entries at most ``days`` days old."""
    return crawled.filter(F.col("crawled_at") >= as_time(now) - F.make_dt_interval(F.lit(days)))

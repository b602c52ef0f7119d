"""Lookups against keyed tables: the crawl cache, domain lists, hot-key joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.functions import urls

#: How many ways a hot key is split in a salted join.
SALT = 16
CACHE_DAYS = 30

# ---- Fixed values: hosts a web search need not return (aggregators, social sites)
ALWAYS_SKIP = [
    "linkedin.com", "indeed.", "glassdoor.", "ziprecruiter.com",
    "jooble.org", "talent.com", "jobrapido.com", "bebee.com", "dailyremote.com",
    "facebook.com", "instagram.com", "twitter.com", "x.com",
    "youtube.com", "reddit.com", "tiktok.com",
]


def as_time(now: dt.datetime | str | Column) -> Column:
    """``now`` is always handed in, never read off a clock."""
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


#: A host's name is never longer.
HOST_CHARS = 253


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    salt: int = SALT,
) -> DataFrame:
    """Join where ``left`` may hold one key very often and ``right`` has it once.

    ``spread`` columns of the left decide which of ``salt`` copies of the right
    row a left row meets, so the copies of one key go to ``salt`` tasks. Only for
    narrow right sides, since they are written ``salt`` times. Where the right
    side turns out small at run time, adaptive execution broadcasts it instead.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salt)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def recent(crawled: DataFrame, now, days: int = CACHE_DAYS) -> DataFrame:
    """Cache entries that still count: strictly younger than ``days`` days."""
    floor = as_time(now) - F.make_dt_interval(F.lit(days))
    return (
        crawled.filter(F.col("crawled_at") > floor)
        .groupBy("url")
        .agg(F.max("crawled_at").alias("crawled_at"))
    )


def not_crawled(ads: DataFrame, crawled: DataFrame, now, days: int = CACHE_DAYS) -> DataFrame:
    """Ads whose URL, as written, is not in the recent cache."""
    urls_seen = recent(crawled, now, days).select("url")
    return salted_join(ads, urls_seen, ["url"], "left_anti", spread=_spread(ads))


def flag_crawled(ads: DataFrame, crawled: DataFrame, now, days: int = CACHE_DAYS) -> DataFrame:
    """Add ``cached``: is the URL in the recent cache?"""
    seen = recent(crawled, now, days).select("url", F.lit(True).alias("cached"))
    return salted_join(ads, seen, ["url"], "left", spread=_spread(ads)).withColumn(
        "cached", F.coalesce("cached", F.lit(False))
    )


def _spread(df: DataFrame) -> list[str]:
    """Columns that tell the copies of a URL apart: the arrival order if known."""
    for name in ("arrival", "seq"):
        if name in df.columns:
            return [name]
    return list(df.columns)


def skipped_by(url: str, domains) -> Column:
    """Unparsable, or the host contains one of the strings."""
    name = F.lower(urls.host(url))
    hit = ~urls.url_parses(url)
    for d in domains:
        hit = hit | F.contains(name, F.lit(d))
    return hit


def skip_domains(df: DataFrame, domains, url_col: str = "url") -> DataFrame:
    """Rows whose host contains none of the skip strings.

    ``domains`` is a list of strings or a DataFrame with a column ``domain``. The
    test is a substring one, which no equi-join can express; so each distinct
    host is tested once and the verdict is joined back by host.
    """
    if not isinstance(domains, DataFrame):
        return df.filter(~skipped_by(url_col, domains))
    named = df.withColumn("__host", F.lower(urls.host(url_col))).filter(urls.url_parses(url_col))
    hosts = named.select("__host").distinct()
    # Substrings of a host, each once: an equi-join on them replaces the theta join.
    domains = domains.select("domain").filter(F.length("domain") <= HOST_CHARS).distinct()
    # Only of lengths that occur in the table: a number for each of them comes to the driver.
    sizes = sorted(r[0] for r in domains.select(F.length("domain")).distinct().collect())
    parts = hosts.select("__host", F.explode(_substrings(F.col("__host"), sizes)).alias("domain"))
    skipped = salted_join(parts, domains, ["domain"], "left_semi", spread=["__host"])
    skipped = skipped.select("__host").distinct()
    return salted_join(named, skipped, ["__host"], "left_anti", spread=_spread(df)).drop("__host")


def _substrings(text: Column, sizes: list[int]) -> Column:
    """The distinct substrings of those lengths."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        every = F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(none)

    return F.array_distinct(F.concat(none, *(of(n) for n in sizes)))


def derive_skip_domains(
    spark, source_domains: dict[str, list[str]], enabled, extra=(), fixed=tuple(ALWAYS_SKIP)
) -> DataFrame:
    """Fixed and extra strings, plus the domains of the enabled sources only."""
    rows = [*fixed, *extra]
    rows += [d for name, ds in source_domains.items() if enabled(name) for d in ds]
    return spark.createDataFrame([(d,) for d in rows], "domain string").distinct()

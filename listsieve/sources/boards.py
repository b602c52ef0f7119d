"""The known sources: what each reads, which hosts it covers, and their union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listsieve.operators.lookup import ALWAYS_SKIP, derive_skip_domains
from listsieve.operators.enrich import MAX_PAGES, VERIFY_LIMIT
from listsieve.sources import cards, embedded, feeds, markdown, search, threads

Adapter = Callable[..., DataFrame]


@dataclass(frozen=True)
class Source:
    """An ingestion function by name, with the hosts it covers.

    ``needs`` names the setting that must be non-empty for the source to run; an adapter that
    ``cuts`` descriptions takes ``max_bytes``.
    """

    name: str
    domains: tuple[str, ...]
    adapter: Adapter
    needs: str = ""
    cuts: bool = False


@dataclass(frozen=True)
class Settings:
    """What a run says about one source; a source not mentioned is enabled."""

    enabled: bool = True
    pages: tuple[str, ...] = ()
    feeds: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()
    require: str = ""
    verify_limit: int = 0
    max_pages_per_run: int = 0
    skip_domains: tuple[str, ...] = ()
    whole_descriptions: bool = False


# ---- Fixed values: the sources, in the order they are read, and their defaults ----
_KNOWN = [
    Source("remoteok", ("remoteok.com",), feeds.read_json_feed, cuts=True),
    Source("remotive", ("remotive.com",), feeds.read_nested_json_feed, cuts=True),
    Source("weworkremotely", ("weworkremotely.com",), feeds.read_rss, cuts=True),
    Source("hackernews", ("news.ycombinator.com",), threads.thread_to_ads, cuts=True),
    Source("devbg", ("dev.bg", "h512.com"), cards.read_title_cards, "pages"),
    Source("justjoin", ("justjoin.it",), cards.read_link_cards, "pages"),
    Source("arcdev", ("arc.dev",), embedded.read_embedded_json, "pages"),
    Source("djinni", ("djinni.co",), cards.read_full_cards, "pages", cuts=True),
    Source("jobsbg", ("jobs.bg", "tech.bg"), markdown.read_markdown, "pages"),
    Source("serper", (), search.hits_to_ads, "queries"),
]
DEFAULT_CATEGORIES = ("software-dev",)
DEFAULT_FEEDS = ("https://weworkremotely.com/categories/remote-programming-jobs.rss",)
# ------------------------------------------------------------------------------------


@dataclass
class Sources:
    """A registry of sources and the settings of a run."""

    settings: dict[str, Settings] = field(default_factory=dict)
    known: dict[str, Source] = field(default_factory=lambda: {s.name: s for s in _KNOWN})

    def __post_init__(self):
        for name in self.settings:
            if name not in self.known:
                raise ValueError(f"unknown source {name!r} (known: {', '.join(self.known)})")

    def register(self, source: Source) -> None:
        self.known[source.name] = source

    def of(self, name: str) -> Settings:
        return self.settings.get(name, Settings())

    def enabled(self, name: str) -> bool:
        """Switched on, and given the list it needs, if it needs one."""
        needs = self.known[name].needs
        return self.of(name).enabled and (not needs or bool(getattr(self.of(name), needs)))

    def active(self) -> list[str]:
        return [name for name in self.known if self.enabled(name)]

    def categories(self) -> tuple[str, ...]:
        return self.of("remotive").categories or DEFAULT_CATEGORIES

    def feeds(self) -> tuple[str, ...]:
        return self.of("weworkremotely").feeds or DEFAULT_FEEDS

    def verify_limits(self) -> dict[str, int]:
        """Budgets of the enabled sources whose pages are re-read."""
        limits = {n: self.of(n).verify_limit for n in self.active() if self.of(n).verify_limit > 0}
        if self.enabled("justjoin"):
            limits.setdefault("justjoin", VERIFY_LIMIT)
        return limits

    def max_pages(self) -> int:
        return self.of("serper").max_pages_per_run or MAX_PAGES

    def skip_list(self) -> list[str]:
        """Strings a search hit's host must not contain."""
        covered = [d for n in self.active() for d in self.known[n].domains]
        return [*ALWAYS_SKIP, *self.of("serper").skip_domains, *covered]

    def skip_table(self, spark: SparkSession) -> DataFrame:
        domains = {n: list(s.domains) for n, s in self.known.items()}
        return derive_skip_domains(spark, domains, self.enabled, self.of("serper").skip_domains)

    def read(self, name: str, raw: DataFrame) -> DataFrame:
        """Run one source's ingestion function on its raw responses."""
        source, own = self.known[name], self.of(name)
        whole = {"max_bytes": None} if source.cuts and own.whole_descriptions else {}
        if name == "serper":
            return source.adapter(raw, self.skip_list(), name)
        if name == "hackernews":
            return source.adapter(raw, own.require, name, **whole)
        return source.adapter(raw, name, **whole)

    def ingest(self, raws: dict[str, DataFrame]) -> DataFrame:
        """Read and unite all enabled sources there is raw data for."""
        return union_sources(
            {n: self.read(n, raws[n]) for n in self.active() if n in raws}, self.enabled
        )


def union_sources(ads: dict[str, DataFrame], enabled: Callable[[str], bool] = lambda _: True) -> DataFrame:
    """Bag union in the given order; the order becomes part of the arrival."""
    wanted = [df for name, df in ads.items() if enabled(name)]
    if not wanted:
        raise ValueError("no source is enabled")
    numbered = [
        df.withColumn("arrival", _renumber(F.col("arrival"), i)) for i, df in enumerate(wanted)
    ]
    return reduce(DataFrame.unionByName, numbered)


def _renumber(arrival: Column, i: int) -> Column:
    return arrival.withField("source_ord", F.lit(i))

"""One scheduled run: raw responses in, next state, fresh rows and metrics out."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listsieve import schema as sc
from listsieve.functions import lexicon as lx
from listsieve.operators.enrich import DESCRIPTION_BYTES, enrich, update_crawled, verify
from listsieve.operators.evaluate import evaluate, matched, purge, run_metrics, without_rejected
from listsieve.operators.merge import hidden_keys, merge_fresh, merge_state, prepare
from listsieve.operators.views import digest
from listsieve.plans.runtime import cut_lineage
from listsieve.profile import Profile
from listsieve.sources.raw import ingest_report
from listsieve.sources.state_store import StateStore

SEARCH = "serper"


def profile_name(profile: Profile, lexicon: lx.Lexicon = lx.DEFAULT_LEXICON) -> str:
    """Differs where the rules differ."""
    return hashlib.sha256(repr((profile, lexicon)).encode()).hexdigest()


def start_up(store: StateStore, profile: Profile, lexicon: lx.Lexicon = lx.DEFAULT_LEXICON) -> int:
    """Drop stored listings that a changed profile no longer wants; returns how many went.

    The store knows by which profile it was purged last, so an unchanged one costs nothing.
    """
    name = profile_name(profile, lexicon)
    if store.version() is None or store.manifest(store.version()).profile == name:
        return 0
    def purged(base: int | None) -> dict:
        return {"state": purge(store.load(base), profile, lexicon)}

    version = store.update(purged, profile=name, touched={"state": list(range(store.buckets))})
    return store.load(version - 1).count() - store.load(version).count()


@dataclass
class Run:
    """What a run produced; the frames read stored rows."""

    version: int
    fresh: DataFrame
    metrics: DataFrame
    verification: DataFrame | None
    digest: DataFrame
    pages: DataFrame | None = None


def run_once(
    store: StateStore,
    ads: DataFrame,
    profile: Profile,
    now,
    pages: DataFrame | None = None,
    limits: dict[str, int] | None = None,
    max_pages: int = 0,
    lexicon: lx.Lexicon = lx.DEFAULT_LEXICON,
    batch: str = "",
    pages_read: DataFrame | None = None,
    max_bytes: int | None = DESCRIPTION_BYTES,
) -> Run:
    """Enrich search hits, evaluate, verify, merge, save.

    ``ads`` is the union of all sources; ``pages_read`` (source, ok), what the sources say of
    their pages, becomes the run's page report; ``max_bytes`` of a search hit's page are
    kept (None: all). The evaluated batch is stored once,
    since verification, the merge and the metrics all read it; so is the batch
    that reaches the merge. Of the state the touched buckets are read and rewritten; where another
    writer commits meanwhile, only the merge is done again. A batch that was taken in before
    changes nothing and has no fresh rows.
    """
    crawled = store.load_crawled()
    new_cache = crawled.limit(0)
    if pages is not None and max_pages > 0:
        # The union is read twice here, so it is stored first.
        ads = cut_lineage(ads)
        hits = enrich(ads.filter(F.col("source") == SEARCH), pages, crawled, now, max_pages, max_bytes=max_bytes)
        ads = ads.filter(F.col("source") != SEARCH).unionByName(hits.ads)
        new_cache = new_cache.unionByName(hits.crawled)

    evaluated = evaluate(ads, profile, lexicon)
    stored = cut_lineage(without_rejected(evaluated))
    batch_rows = matched(stored)
    verification = None
    if pages is not None and limits:
        result = verify(batch_rows, pages, crawled, limits, profile, now, lexicon)
        batch_rows = cut_lineage(result.ads)
        verification = cut_lineage(result.metrics)
        new_cache = new_cache.unionByName(result.crawled)

    incoming = cut_lineage(prepare(batch_rows))  # once, for the state and the fresh rows
    new_cache = cut_lineage(new_cache)
    touched = {"state": store.touched(incoming), "crawled": store.touched(new_cache, "url")}
    fresh = store.spark.createDataFrame([], T.StructType([*sc.STATE.fields, T.StructField("arrival", sc.ARRIVAL)]))

    def merged(base: int | None) -> dict:
        """Of the state only the buckets that the batch touches; its hidden keys are all read."""
        nonlocal fresh
        state, hidden = store.load(base, touched["state"]), hidden_keys(store.load(base))
        fresh = cut_lineage(merge_fresh(state, incoming, now, prepared=True, hidden=hidden))
        return {
            "state": merge_state(state, incoming, now, prepared=True, hidden=hidden),
            "crawled": update_crawled(store.load_crawled(base, touched["crawled"]), new_cache, now),
            # the first rows are already by this profile; later ones do not vouch for those before
            "profile": profile_name(profile, lexicon) if base is None else None,
        }

    version = store.update(merged, batch, touched=touched, now=now, placed=True)
    report = None if pages_read is None else ingest_report(pages_read, stored)
    return Run(version, fresh, run_metrics(stored, fresh), verification, digest(fresh), report)

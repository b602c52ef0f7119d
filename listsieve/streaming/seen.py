"""Dropping what was seen before, with the built-in streaming operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from listsieve.functions.urls import ad_id, normalize_url


def first_sightings(stream: DataFrame, event_time: str = "seen_at", days: int = 60) -> DataFrame:
    """Ads whose id did not occur within ``days`` days before.

    The time an id is remembered starts at its first sighting, so this is an
    approximation of the state merge for streams that keep no state table.
    """
    keyed = stream.withColumn("url", normalize_url("url")).withColumn("id", ad_id("source", "url"))
    return keyed.withWatermark(event_time, f"{days} days").dropDuplicatesWithinWatermark(["id"])

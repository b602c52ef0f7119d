"""The merge as a stateful operator: one small state per id, kept by Spark.

Input rows are sightings ``(id, seen_at, hidden, status)``; a row with a status sets it ('' clears
it), one without is only a sighting. Output is one row per trigger and id with the id's state
after it, and whether the id was new.

What a trigger brings for an id is order-free: the earliest and the latest sighting, whether one
was hidden, the last status by time. So it is collapsed by column operations within each batch of
each task first, before anything is shuffled, and a very frequent id costs a row a batch; and the
result is the same whatever order the rows come in. A timer per id drops its state once the
watermark has passed the retention time after its last sighting, unless it is tracked by then.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from listsieve.operators.merge import RETENTION_DAYS

OUTPUT = "id string, first_seen timestamp, last_seen timestamp, hidden boolean, status string, fresh boolean"
_STATE = "first_us long, last_us long, hidden boolean, status string, status_us long"
#: What is known of an id's sightings: the first and the last one, whether the first and whether
#: any one was hidden, the last status and its time.
_SEEN = "id string, first_us long, last_us long, first_hidden boolean, hidden boolean, status string, status_us long"
_NAMES = [field.split()[0] for field in _SEEN.split(", ")]
_NEVER = np.iinfo(np.int64).min


def collapse(seen: pd.DataFrame) -> pd.DataFrame:
    """One row per id of rows of that shape. Of several first sightings one hidden is enough; of
    several statuses at the last time the greatest counts."""
    seen = seen[seen["id"].notna()]
    out = seen.groupby("id").agg(first_us=("first_us", "min"), last_us=("last_us", "max"), hidden=("hidden", "any"))
    first = seen["first_us"].to_numpy() == out["first_us"].loc[seen["id"]].to_numpy()
    out["first_hidden"] = seen[first].groupby("id")["first_hidden"].any()
    told = seen.loc[seen["status"].notna(), ["id", "status", "status_us"]]
    told = told.sort_values(["status_us", "status"]).drop_duplicates("id", keep="last").set_index("id")
    out["status"] = told["status"]
    out["status_us"] = told["status_us"].reindex(out.index, fill_value=_NEVER)
    return out.reset_index()[_NAMES]


def _collapsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield collapse(batch)


class Seen:
    """What ``collapse`` says of one id, taken in batch by batch. An id has few rows and there are
    very many ids, so it goes over plain values: grouping a frame costs far more than these."""

    def __init__(self):
        self.first_us = self.last_us = self.status = None
        self.first_hidden = self.hidden = False
        self.status_us = _NEVER

    def take(self, batch: pd.DataFrame) -> None:
        columns = [batch[name].tolist() for name in _NAMES[1:]]
        for first, last, first_hidden, hidden, status, status_us in zip(*columns):
            if self.first_us is None or first < self.first_us:
                self.first_us, self.first_hidden = first, first_hidden
            elif first == self.first_us:
                self.first_hidden = self.first_hidden or first_hidden
            if self.last_us is None or last > self.last_us:
                self.last_us = last
            self.hidden = self.hidden or hidden
            if status is not None and (self.status is None or (status_us, status) > (self.status_us, self.status)):
                self.status, self.status_us = status, status_us


def _merged(keep_us: int):
    """The state function for a retention time."""

    def take_in(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if not state.get[3]:
                state.remove()
            return
        seen = Seen()
        for batch in batches:  # an id's rows, few as they are collapsed; never held together
            seen.take(batch)
        first, last, hidden, status, status_us = state.get if state.exists else (None, None, False, "", _NEVER)
        if first is not None and not status and seen.first_us - last > keep_us:
            first, hidden, status_us = None, False, _NEVER  # gone stale before
        new = first is None
        first = seen.first_us if new else min(first, seen.first_us)
        last = seen.last_us if new else max(last, seen.last_us)
        hidden = hidden or seen.hidden
        if seen.status is not None and seen.status_us >= status_us:
            status, status_us = seen.status, seen.status_us
        state.update((first, last, hidden, status, status_us))
        expiry = (last + keep_us) // 1000 + 1
        if not status and expiry > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expiry)
        fresh = new and not seen.first_hidden
        yield pd.DataFrame(
            {
                "id": [key[0]],
                "first_seen": np.array([first], "datetime64[us]"),
                "last_seen": np.array([last], "datetime64[us]"),
                "hidden": [hidden],
                "status": [status],
                "fresh": [fresh],
            }
        )

    return take_in


def stateful_merge(
    sightings: DataFrame,
    event_time: str = "seen_at",
    delay: str = "1 day",
    retention: dt.timedelta = dt.timedelta(days=RETENTION_DAYS),
) -> DataFrame:
    """Freshness per trigger and id over a stream of sightings. One without a time is dropped; a
    null ``hidden`` is false."""
    at = F.unix_micros(F.col(event_time))
    seen = sightings.filter(F.col(event_time).isNotNull())
    hidden = F.coalesce("hidden", F.lit(False))
    told = F.when(F.col("status").isNotNull(), at).otherwise(F.lit(_NEVER))
    seen = seen.select(
        "id",
        at.alias("first_us"),
        at.alias("last_us"),
        hidden.alias("first_hidden"),
        hidden.alias("hidden"),
        "status",
        told.alias("status_us"),
    )
    keep_us = int(retention.total_seconds() * 1_000_000)
    return (
        seen.mapInPandas(_collapsed, _SEEN)
        .withColumn(event_time, F.timestamp_micros("last_us"))
        .withWatermark(event_time, delay)
        .groupBy("id")
        .applyInPandasWithState(_merged(keep_us), OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )

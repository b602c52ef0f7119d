"""Hiding, unhiding and status changes, many at a time."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.functions.match import valid_status
from listsieve.operators.lookup import as_time


class Updated(NamedTuple):
    state: DataFrame
    rejected: DataFrame  # id, problem


def collapse_updates(updates: DataFrame, order: str) -> DataFrame:
    """One row per id; for each field the last value given by ``order``. Unknown statuses go."""
    for name, kind in (("hidden", "boolean"), ("status", "string")):
        if name not in updates.columns:
            updates = updates.withColumn(name, F.lit(None).cast(kind))
    by = F.col(order)
    known = updates.filter(F.col("status").isNull() | valid_status())

    def last(name: str):
        # max_by skips rows whose ordering is NULL: those that leave the field alone.
        return F.max_by(name, F.when(F.col(name).isNotNull(), by)).alias(f"new_{name}")

    return known.groupBy("id").agg(last("hidden"), last("status"))


def apply_updates(state: DataFrame, updates: DataFrame, now, order: str) -> Updated:
    """Apply ``(id, hidden, status)`` updates; NULL leaves a field alone.

    An empty status clears the status and its time. Updates to unknown ids and
    with unknown statuses come back as ``rejected`` instead.
    """
    changes = collapse_updates(updates, order)
    joined = state.join(changes, "id", "left")
    new_status = F.col("new_status")
    changed = joined.withColumns(
        {
            "hidden": F.coalesce("new_hidden", "hidden"),
            "status": F.coalesce(new_status, F.col("status")),
            "status_at": F.when(new_status.isNull(), F.col("status_at")).when(
                new_status != "", as_time(now)
            ),
        }
    ).select(*state.columns)
    return Updated(changed, rejected_updates(state, updates))


def rejected_updates(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that cannot be applied, each with its problem, once per id."""
    if "status" not in updates.columns:
        updates = updates.withColumn("status", F.lit(None).cast("string"))
    bad = F.col("status").isNotNull() & ~valid_status()
    ids = updates.groupBy("id").agg(F.bool_or(bad).alias("bad"), F.bool_or(~bad).alias("good"))
    unknown = (
        ids.filter("good")
        .join(state.select("id"), "id", "left_anti")
        .select("id", F.lit("unknown id").alias("problem"))
    )
    invalid = ids.filter("bad").select("id", F.lit("unknown status").alias("problem"))
    return unknown.unionByName(invalid)

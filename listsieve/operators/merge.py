"""The keyed upsert of a batch into the state.

State and batch meet in one full outer join on ``id``, which is unique on both
sides. With the state stored bucketed by ``id`` only the batch is shuffled. All
that a batch says about one id is first collapsed by an aggregation, so repeats
of one listing cost a row per task. Suppression by content key runs on
``(id, key)`` pairs alone, salted, because one key can stand for very many ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve import schema as sc
from listsieve.functions.match import tracked
from listsieve.functions.urls import ad_id, content_key, normalize_url
from listsieve.operators.lookup import SALT, as_time, salted_join

RETENTION_DAYS = 60


def identify(batch: DataFrame, unicode_keys: bool = False) -> DataFrame:
    """Normalised URL, id and content key, with absent state columns filled in."""
    fields = [*sc.CONTENT_FIELDS, *sc.SCORE_FIELDS, *sc.TRACKING_FIELDS]
    df = sc.conform_keep(batch, fields)
    df = sc.settle(df, {"url": normalize_url("url")})
    keys = {
        "id": ad_id("source", "url"),
        "content_key": content_key("company", "title", unicode_keys),
    }
    return sc.settle(df, keys)


def collapse_batch(identified: DataFrame, order: str = "arrival") -> DataFrame:
    """One row per id: the last content, the first row's flags and content.

    The last occurrence is what gets stored, the first decides whether the id is
    reported and suppressed, and being hidden once is enough.
    """
    content = F.struct(*sc.CONTENT, *sc.SCORED)
    flags = F.struct("content_key", "hidden", "status", "status_at")
    return identified.groupBy("id").agg(
        F.max_by(content, F.col(order)).alias("last"),
        F.min_by(content, F.col(order)).alias("first"),
        F.min_by(flags, F.col(order)).alias("flags"),
        F.min(order).alias(order),
        F.bool_or("hidden").alias("any_hidden"),
    )


def hidden_keys(state: DataFrame, unicode_keys: bool = False) -> DataFrame:
    """Content keys of the listings hidden so far."""
    return (
        state.filter("hidden")
        .select(content_key("company", "title", unicode_keys).alias("content_key"))
        .distinct()
    )


def suppress_hidden(
    new: DataFrame,
    state: DataFrame,
    unicode_keys: bool = False,
    salt: int = SALT,
    hidden: DataFrame | None = None,
) -> DataFrame:
    """Ids of ``new`` (``id, content_key``) whose content is hidden in the state. ``hidden`` are
    the keys where ``state`` is but a part of it."""
    keys = hidden_keys(state, unicode_keys) if hidden is None else hidden
    pairs = new.select("id", "content_key")
    return salted_join(pairs, keys, ["content_key"], "left_semi", ["id"], salt).select("id")


def _suppressed(collapsed: DataFrame, state: DataFrame, unicode_keys: bool, salt: int, hidden):
    first = collapsed.select("id", "flags.content_key")
    ids = suppress_hidden(first, state, unicode_keys, salt, hidden)
    return ids.withColumn("suppressed", F.lit(True))


def prepare(batch: DataFrame, order: str = "arrival", unicode_keys: bool = False) -> DataFrame:
    """A batch as the merge takes it in: identified, one row per id. A run that needs both the
    next state and the fresh rows stores it and hands it to both as ``prepared``."""
    return collapse_batch(identify(batch, unicode_keys), order)


def _is(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def merge_state(
    state: DataFrame,
    batch: DataFrame,
    now,
    order: str = "arrival",
    retention_days: int = RETENTION_DAYS,
    unicode_keys: bool = False,
    keep_longer_description: bool = False,
    salt: int = SALT,
    prepared: bool = False,
    hidden: DataFrame | None = None,
) -> DataFrame:
    """The state after the batch, without what has gone stale. ``state`` may be the buckets that
    the batch touches, with the ``hidden_keys`` of the whole as ``hidden``."""
    now = as_time(now)
    collapsed = batch if prepared else prepare(batch, order, unicode_keys)
    suppressed = _suppressed(collapsed, state, unicode_keys, salt, hidden)
    incoming = (
        collapsed.join(suppressed, "id", "left")
        .select("id", "last", "flags", "any_hidden", "suppressed", F.lit(True).alias("in_batch"))
    )
    # The id stays the bare column the state is bucketed by, so no row of it moves.
    old = state.select("id", F.struct(*sc.filled(state, sc.STATE.fields[1:])).alias("old"))
    joined = old.join(incoming, "id", "full_outer")
    is_new = F.col("old").isNull()

    def content(name: str) -> Column:
        taken = F.col(f"last.{name}")
        if name == "description" and keep_longer_description:
            stored = F.coalesce(F.col("old.description"), F.lit(""))
            taken = F.when(F.length(stored) > F.length(taken), stored).otherwise(taken)
        return F.when(_is("in_batch"), taken).otherwise(F.col(f"old.{name}"))

    merged = joined.select(
        "id",
        *[content(name).alias(name) for name in (*sc.CONTENT, *sc.SCORED)],
        F.when(is_new, now).otherwise(F.col("old.first_seen")).alias("first_seen"),
        F.when(_is("in_batch"), now).otherwise(F.col("old.last_seen")).alias("last_seen"),
        F.when(is_new, _is("any_hidden") | _is("suppressed"))
        .otherwise(F.col("old.hidden") | _is("any_hidden"))
        .alias("hidden"),
        F.when(is_new, F.col("flags.status")).otherwise(F.col("old.status")).alias("status"),
        F.when(is_new, F.col("flags.status_at"))
        .otherwise(F.col("old.status_at"))
        .alias("status_at"),
    )
    return retain(merged, now, retention_days)


def merge_fresh(
    state: DataFrame,
    batch: DataFrame,
    now,
    order: str = "arrival",
    unicode_keys: bool = False,
    salt: int = SALT,
    prepared: bool = False,
    hidden: DataFrame | None = None,
) -> DataFrame:
    """Rows never seen before and not hidden, as they first came in.

    Reads only ``id`` and, for hidden rows, the key columns of the state.
    ``last_seen`` is still unset at this point, as the row was reported before
    it was stored.
    """
    now = as_time(now)
    collapsed = batch if prepared else prepare(batch, order, unicode_keys)
    suppressed = _suppressed(collapsed, state, unicode_keys, salt, hidden)
    fresh = (
        collapsed.filter(~F.col("flags.hidden"))
        .join(state.select("id"), "id", "left_anti")
        .join(suppressed, "id", "left_anti")
    )
    rows = fresh.select(
        "id",
        "first.*",
        now.alias("first_seen"),
        F.lit(False).alias("hidden"),
        F.col("flags.status").alias("status"),
        F.col("flags.status_at").alias("status_at"),
        F.col(order),
    )
    names = [f.name for f in sc.STATE.fields]
    return rows.withColumn("last_seen", F.lit(None).cast("timestamp")).select(*names, order)


def merge(state: DataFrame, batch: DataFrame, now, **options) -> tuple[DataFrame, DataFrame]:
    """``(state', fresh)``. Both read the batch, so hand in one that is stored."""
    both = {k: v for k, v in options.items() if k in ("order", "unicode_keys", "salt", "prepared")}
    return merge_state(state, batch, now, **options), merge_fresh(state, batch, now, **both)


def retain(state: DataFrame, now, days: int = RETENTION_DAYS) -> DataFrame:
    """Drop untracked rows, hidden ones too, unseen for more than ``days`` days."""
    floor = as_time(now) - F.make_dt_interval(F.lit(days))
    return state.filter(tracked() | (F.col("last_seen") >= floor))

"""Attribution of events in document order, in relational form.

Events of one part (a page, a user) come in an order. *Labels* pile up until the
next *item* takes them; a *note* goes to the item it names, or else to the last
item before it. The plain way is one window per part, and one part may hold a
third of all rows. So a part is cut into chunks of its order: running counts are
taken inside each chunk, the chunks' totals are summed up per part (one narrow
row per chunk), and each row adds its chunk's starting point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listsieve.operators.lookup import salted_join


def _positions(df: DataFrame, part: str, order: str, chunk: Column) -> DataFrame:
    """Add ``__items`` (items strictly before) and ``__last`` (last item's key)."""
    is_item = F.col("kind") == "item"
    df = df.withColumn("__chunk", chunk)
    key_if_item = F.when(is_item, F.col("key"))

    totals = df.groupBy(part, "__chunk").agg(
        F.count_if(is_item).alias("__n"),
        F.max_by("key", F.when(is_item, F.col(order))).alias("__k"),
    )
    earlier = Window.partitionBy(part).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        part,
        "__chunk",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.last("__k", ignorenulls=True).over(earlier).alias("__k0"),
    )

    here = Window.partitionBy(part, "__chunk").orderBy(order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.withColumns(
        {
            "__n1": F.coalesce(F.count_if(is_item).over(before), F.lit(0)),
            "__k1": F.last(key_if_item, ignorenulls=True).over(upto),
        }
    )
    return inside.join(starts, [part, "__chunk"]).select(
        *df.columns,
        (F.col("__n0") + F.col("__n1")).alias("__items"),
        F.coalesce("__k1", "__k0").alias("__last"),
    )


def attribute_events(
    events: DataFrame, part: str = "page_url", order: str = "pos", chunk: Column | None = None
) -> DataFrame:
    """Items per part with ``title, company, tags`` and their first position.

    ``events`` has ``part, order, kind, key, value``: kind ``label`` (value is the
    label), ``item`` (key and title), ``note`` (key or '', value is the company).
    ``chunk`` cuts the order into ranges and must grow with it; without one a
    part is a single chunk, which suits parts of bounded size such as pages.

    An item seen again keeps the longest title in bytes and takes no labels. The
    first note that is not empty wins, if its item had appeared before it.
    """
    events = events.withColumn("key", F.coalesce("key", F.lit("")))
    placed = _positions(events, part, order, F.lit(0) if chunk is None else chunk)
    pos = F.col(order)

    items = placed.filter(F.col("kind") == "item")
    # Of equally long titles the earliest, then the longest; one pass, no join.
    heads = (
        items.groupBy(part, "key", F.octet_length("value").alias("__len"))
        .agg(
            F.min_by("value", pos).alias("title"),
            F.min_by("__items", pos).alias("__items"),
            F.min(order).alias("__at"),
        )
        .groupBy(part, "key")
        .agg(
            F.max_by("title", "__len").alias("title"),
            F.min_by("__items", "__at").alias("__items"),
            F.min("__at").alias("first_pos"),
        )
    )

    # Distinct labels per item first: what is collected is bounded by the vocabulary.
    labels = (
        placed.filter(F.col("kind") == "label")
        .groupBy(part, "__items", F.col("value").alias("label"))
        .agg(F.min(order).alias("at"))
        .groupBy(part, "__items")
        .agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("found"))
        .select(part, "__items", F.col("found.label").alias("tags"))
    )

    notes = (
        placed.filter((F.col("kind") == "note") & (F.col("value") != ""))
        .select(
            part,
            F.when(F.col("key") != "", F.col("key")).otherwise(F.col("__last")).alias("key"),
            pos.alias("at"),
            F.col("value").alias("company"),
        )
        .filter(F.col("key").isNotNull())
    )
    # An item may be named by very many notes; it appears on the right once.
    named = salted_join(
        notes, heads.select(part, "key", "first_pos"), [part, "key"], "inner", spread=["at"]
    )
    companies = (
        named.filter(F.col("at") > F.col("first_pos"))
        .groupBy(part, "key")
        .agg(F.min_by("company", F.col("at")).alias("company"))
    )

    return (
        heads.join(labels, [part, "__items"], "left")
        .join(companies, [part, "key"], "left")
        .select(
            part,
            "key",
            "first_pos",
            "title",
            F.coalesce("company", F.lit("")).alias("company"),
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        )
    )

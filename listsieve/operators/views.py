"""Reading the state: filtered and ranked lists, facets, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.functions.match import status_filter
from listsieve.functions.text import fit_label

DIGEST_ROWS = 10


def parse_min(value) -> int:
    """A lower bound as typed by a user; anything unreadable means 0."""
    try:
        return int(str(value).strip())
    except (TypeError, ValueError):
        return 0


def filter_ads(
    state: DataFrame,
    source: str = "",
    fit: str = "",
    status: str = "",
    min: int | str = 0,
    q: str = "",
    hidden: str | bool = "",
) -> DataFrame:
    """AND of all given filters. Source, score, fit, status and hidden are tests on
    plain columns, so they reach the parquet scan; the text search runs last."""
    show_hidden = hidden is True or hidden == "1"
    df = state.filter(F.col("hidden") if show_hidden else ~F.col("hidden"))
    if status:
        df = df.filter(status_filter(status))
    if source:
        df = df.filter(F.col("source") == source)
    df = df.filter(F.col("score") >= parse_min(min))
    if fit:
        df = df.filter(F.startswith("fit", F.lit(fit)))
    if q:
        text = F.lower(F.concat_ws(" ", "title", "company", "description"))
        df = df.filter(F.contains(text, F.lit(q.lower())))
    return df


def rank(state: DataFrame, limit: int | None = None) -> DataFrame:
    """Best score first, then the most recently found; the id settles ties."""
    ordered = state.orderBy(F.desc("score"), F.desc("first_seen"), "id")
    return ordered if limit is None else ordered.limit(limit)


def list_ads(state: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """Filter first, then sort; a limit turns the sort into a top-k."""
    return rank(filter_ads(state, **filters), limit)


def facets(state: DataFrame) -> DataFrame:
    """``(facet, value)``: sources and fit labels in the state, hidden rows included."""
    values = F.array(
        F.struct(F.lit("source").alias("facet"), F.col("source").alias("value")),
        F.struct(F.lit("fit").alias("facet"), fit_label("fit").alias("value")),
    )
    # Distinct pairs of the two columns first: few rows are left to unpivot.
    return (
        state.select("source", "fit")
        .distinct()
        .select(F.inline(values))
        .filter(F.col("value") != "")
        .distinct()
        .orderBy(F.desc("facet"), "value")
    )


def status_choices() -> list[tuple[str, str]]:
    """Values of the status filter and their labels."""
    from listsieve.functions.match import VALID_STATUSES

    special = [("", "any status"), ("none", "not applied"), ("tracked", "applied — any")]
    return special + [(s, s) for s in VALID_STATUSES]


def digest(fresh: DataFrame, max_listed: int = DIGEST_ROWS, order: str = "arrival") -> DataFrame:
    """One row with the message about new matches; no row when there are none.

    A count and a top-k over the fresh rows; only the listed rows are collected
    into the text.
    """
    total = fresh.agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat(
        F.lit("• ["), F.col("score").cast("string"), F.lit("] "), F.col("title"), F.lit(" — "),
        F.col("company"), F.lit(" ("), F.col("fit"), F.lit(", "), F.col("source"), F.lit(")\n"),
        F.col("url"), F.lit("\n\n"),
    )
    listed = (
        fresh.orderBy(order)
        .limit(max_listed)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), entry.alias("line")))).alias("top"))
    )
    more = F.when(
        F.col("n") > max_listed,
        F.concat(F.lit("… and "), (F.col("n") - max_listed).cast("string"), F.lit(" more\n")),
    ).otherwise("")
    header = F.concat(F.lit("🔍 "), F.col("n").cast("string"), F.lit(" new job match(es)\n\n"))
    # Both sides are a single row.
    return (
        total.filter(F.col("n") > 0)
        .join(listed, F.lit(True))
        .select(F.concat(header, F.array_join(F.col("top.line"), ""), more).alias("text"))
    )


def export_json(df: DataFrame, path: str) -> None:
    """Write a list as JSON, one object per line."""
    df.write.mode("overwrite").json(path)

"""Explicit schemas, and the rule that the empty string is the only "missing"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a row came from, in the order rows are considered to have arrived.
#: A struct compares field by field, so it can be used wherever an order is.
ARRIVAL = T.StructType(
    [
        T.StructField("source_ord", T.IntegerType()),
        T.StructField("page_seq", T.LongType()),
        T.StructField("page_url", T.StringType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

#: Raw input of every ingestion function: one fetched response per row.
RAW = T.StructType(
    [
        T.StructField("page_url", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

CONTENT_FIELDS = [
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("posted_at", T.TimestampType()),
]

SCORE_FIELDS = [
    T.StructField("score", T.IntegerType()),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("fit", T.StringType()),
]

TRACKING_FIELDS = [
    T.StructField("hidden", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("status_at", T.TimestampType()),
]

#: What ingestion emits.
ADS = T.StructType([*CONTENT_FIELDS, T.StructField("arrival", ARRIVAL)])

#: The persistent keyed state.
STATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        *CONTENT_FIELDS,
        *SCORE_FIELDS,
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        *TRACKING_FIELDS,
    ]
)

CRAWLED = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("crawled_at", T.TimestampType())]
)

PAGE_RESULTS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

CONTENT = [f.name for f in CONTENT_FIELDS]
SCORED = [f.name for f in SCORE_FIELDS]
TRACKING = [f.name for f in TRACKING_FIELDS]

_EMPTY = {"string": "''", "int": "0", "boolean": "false"}


def fill(field: T.StructField, value: Column) -> Column:
    """Cast to the field's type; a missing value becomes the type's empty value."""
    kind = field.dataType
    value = value.cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(value, F.array().cast(kind))
    default = _EMPTY.get(kind.simpleString())
    return value if default is None else F.coalesce(value, F.expr(default))


def filled(df: DataFrame, fields: list[T.StructField]) -> list[Column]:
    """One column per field, from the frame where it has it."""
    present = set(df.columns)
    given = [F.col(f.name) if f.name in present else F.lit(None) for f in fields]
    return [fill(f, value).alias(f.name) for f, value in zip(fields, given)]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in its order; absent ones get empty values."""
    return df.select(*filled(df, schema.fields))


def conform_keep(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Fill in ``fields`` and leave every other column alone."""
    return df.withColumns({f.name: c for f, c in zip(fields, filled(df, fields))})


def arrival(source_ord: int | Column = 0, page_seq=None, page_url=None, pos=None) -> Column:
    """Build the arrival struct; whatever is left out is constant."""

    def col(value, default):
        return F.lit(default) if value is None else value

    order = source_ord if isinstance(source_ord, Column) else F.lit(source_ord)
    return F.struct(
        order.cast("int").alias("source_ord"),
        col(page_seq, 0).cast("long").alias("page_seq"),
        col(page_url, "").cast("string").alias("page_url"),
        col(pos, 0).cast("int").alias("pos"),
    )


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that filters and joins further up must not compute again.

    Catalyst moves a predicate below the projection it refers to by copying the
    projected expression into it. For costly columns that doubles the work, and
    for layered ones it multiplies. Predicates do not move below a generator, so
    the columns come out of one that yields exactly one row.
    """
    kept = [c for c in df.columns if c not in columns]
    names = {name: f"__settled_{i}" for i, name in enumerate(columns)}
    computed = df.select("*", *[value.alias(names[name]) for name, value in columns.items()])
    values = F.struct(*[F.col(names[name]).alias(name) for name in columns])
    return computed.select(*kept, F.inline(F.array(values)))

"""First-wins and last-wins collapsing of repeated keys.

Both are plain aggregations: every task first collapses its own copies of a key,
so a key that a third of all rows share costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys=("source", "url"), order: str = "arrival") -> DataFrame:
    """The first row per key in arrival order, all columns kept."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("__first"))
        .select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns])
    )

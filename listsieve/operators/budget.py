"""First-k-per-group and first-k-overall, without one task seeing everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Slices of a part that are ranked apart where a budget is large.
SLICES = 64


def budget(
    df: DataFrame,
    k: int,
    part: str | None = "source",
    order: str = "arrival",
    own: Column | None = None,
) -> DataFrame:
    """The first ``k`` rows per ``part`` value, or overall.

    Per part, a rank filter: each task drops all but its own first ``k`` rows of
    a part before the shuffle, so a part of any size costs ``k`` rows per task.
    Spark does so up to a threshold of ``k``; beyond it the rows are first ranked in
    ``SLICES`` slices of each part, and only each slice's first ``k`` meet.
    ``own`` may lower the budget of single parts. Overall, a sort with a limit,
    which keeps ``k`` rows per task the same way.
    """
    if part is None:
        return df.orderBy(order).limit(k)
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        sliced = df.withColumn("__slice", F.pmod(F.xxhash64(order), F.lit(SLICES)))
        in_slice = Window.partitionBy(part, "__slice").orderBy(order)
        df = sliced.withColumn("__rank", F.row_number().over(in_slice)).filter(F.col("__rank") <= k)
        df = df.drop("__rank", "__slice")
    rank = F.row_number().over(Window.partitionBy(part).orderBy(order))
    within = F.col("__rank") <= k
    if own is not None:
        within = within & (F.col("__rank") <= own)
    return df.withColumn("__rank", rank).filter(within).drop("__rank")

"""Connected components of a graph given as an edge table.

Large and small stars by turns: every round points nodes at smaller neighbours, with joins
and partial aggregates only, until no edge changes. The table is written each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.llm.tables import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of a node that are larger (large) or smaller (small, and the
    node itself) are tied to the least of all."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    tied = pairs.join(least, "a")
    if large:
        tied = tied.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return tied.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node it is joined with."""
    stars = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        old, stars = stars, stored(_star(_star(stars, large=True), large=False), "edges")
        discard(old)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

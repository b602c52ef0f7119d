"""Entries of one big JSON object, read by as many tasks as the file has blocks.

The text reader cuts the file at a character (its record separator), so a large file is split like
any other. Whether a cut is a real one follows from what stands before it: an odd number of quotes
means that it is inside a string, and the braces outside strings give the depth. Both are running
sums, taken within the blocks of a file and carried from block to block, so no task holds more than
a block and no entry more than itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STRING = r'"((?:[^"\\]|\\.)*)"'


def segments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, at, value): the text between separators; ``at`` orders a block's."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def _before(rows: DataFrame, **sums: Column) -> DataFrame:
    """Add the sums over all rows before each one in its file."""
    rows = rows.withColumns({f"_{name}": value.cast("long") for name, value in sums.items()})
    blocks = rows.groupBy("file", "block").agg(*(F.sum(f"_{name}").alias(f"_b_{name}") for name in sums))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "file", "block", *(F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums)
    )
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums})
    joined = rows.join(blocks, ["file", "block"]).withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums})
    return joined.drop(*[f"{p}{n}" for n in sums for p in ("_", "_c_")])


def _quotes(rows: DataFrame) -> DataFrame:
    """Add ``clean``, the value without escaped characters, and the quotes before it."""
    rows = rows.withColumn("clean", F.regexp_replace("value", r"(?s)\\.", ""))
    count = F.length("clean") - F.length(F.replace("clean", F.lit('"'), F.lit("")))
    return _before(rows, quotes=count, place=F.lit(1)).withColumn("inside", F.col("quotes") % 2 == 1)


def _glued(rows: DataFrame, start: Column, separator: str) -> DataFrame:
    """(file, entry, text): values from one start to the next; before the first one nothing."""
    rows = _before(rows.withColumn("start", start), entry=F.col("start").cast("int"))
    rows = rows.withColumn("entry", F.col("entry") + F.col("start").cast("int")).where("entry > 0")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))  # of one entry
    return rows.groupBy("file", "entry").agg(F.array_join(parts["value"], separator).alias("text"))


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of an object whose values are objects; ``value`` is their JSON. ``path`` may
    be a folder of such files."""
    rows = _quotes(segments(spark, path, "{"))
    # what a value that begins inside a string has of it is cut off with the closed strings
    whole = F.when(F.col("inside"), F.concat(F.lit('"'), "clean")).otherwise(F.col("clean"))
    outside = F.regexp_replace(F.regexp_replace(whole, r'(?s)"[^"]*"', ""), r'(?s)"[^"]*$', "")
    rows = rows.withColumn("opens", (F.col("place") > 0) & ~F.col("inside"))
    closed = F.length(outside) - F.length(F.replace(outside, F.lit("}"), F.lit("")))
    rows = _before(rows, depth=F.col("opens").cast("int") - closed)
    body = r"(?s)^(.*\})\s*(?:,\s*" + _STRING + r"\s*:\s*|\}\s*)$"
    found = _glued(rows, F.col("opens") & (F.col("depth") == 1), "{").select(
        "file",
        "entry",
        F.concat(F.lit("{"), F.regexp_extract("text", body, 1)).alias("value"),
        F.regexp_extract("text", body, 2).alias("next"),
    )
    # an entry's key stands before it: at the end of the one before, or of what opens the object
    opening = rows.where("opens AND depth = 0").select("file", F.regexp_extract("value", _STRING + r"\s*:\s*$", 1).alias("next"))
    keys = found.select("file", (F.col("entry") + 1).alias("entry"), "next").unionByName(
        opening.select("file", F.lit(1).cast("long").alias("entry"), "next")
    )
    named = found.drop("next").join(keys, ["file", "entry"])
    return named.select(unescaped("next").alias("key"), "value")


def text_entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of an object whose values are strings."""
    rows = _quotes(segments(spark, path, ","))
    found = _glued(rows, (F.col("place") == 0) | ~F.col("inside"), ",")
    pair = _STRING + r"\s*:\s*" + _STRING
    given = found.where(F.rlike("text", F.lit(pair)))
    return given.select(
        unescaped(F.regexp_extract("text", pair, 1)).alias("key"),
        unescaped(F.regexp_extract("text", pair, 2)).alias("value"),
    )


def unescaped(text: str | Column) -> Column:
    """A JSON string's inside as text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.from_json(F.concat(F.lit('{"s":"'), column, F.lit('"}')), "s string")["s"]

"""Landed responses as rows, and the report on which of them could be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listsieve import schema as sc


def read_raw(spark: SparkSession, paths) -> DataFrame:
    """One row per file: its path, its whole text, and 0 as sequence.

    Files order by path where a sequence is needed. One file is one fetched
    response, so its size is bounded by what was fetched at once.
    """
    text = spark.read.text(paths, wholetext=True)
    return text.select(
        F.col("_metadata.file_path").alias("page_url"),
        F.col("value").alias("body"),
        F.lit(0).cast("long").alias("seq"),
    )


def read_raw_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same for files that keep landing in a folder."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("page_url"),
        F.col("value").alias("body"),
        F.lit(0).cast("long").alias("seq"),
    )


def read_page_results(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Fetched pages ``(url, success, markdown, title, error)``; failures kept."""
    return spark.read.schema(sc.PAGE_RESULTS).format(kind).load(path)


def fetched_page_results(raw: DataFrame) -> DataFrame:
    """Page results out of raw fetch responses; ``page_url`` is what was asked for."""
    shape = (
        "success boolean, error string, "
        "data struct<markdown: string, metadata: struct<title: string>>"
    )
    got = raw.select("page_url", F.from_json("body", shape).alias("r"))
    return got.select(
        F.col("page_url").alias("url"),
        F.coalesce("r.success", F.lit(False)).alias("success"),
        F.coalesce("r.data.markdown", F.lit("")).alias("markdown"),
        F.coalesce("r.data.metadata.title", F.lit("")).alias("title"),
        F.coalesce("r.error", F.lit("")).alias("error"),
    )


def successful(pages: DataFrame) -> DataFrame:
    return pages.filter("success")


CORRUPT = "_bad"


def parse_json(body, shape: str) -> Column:
    """JSON by an explicit schema; what does not fit shows up in ``is_bad``."""
    return F.from_json(body, f"{shape}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})


def parse_json_array(body: Column, element: str) -> Column:
    """A top-level JSON array, as the field ``items``."""
    wrapped = F.concat(F.lit('{"items":'), body, F.lit("}"))
    return parse_json(wrapped, f"items array<{element}>")


def is_bad(parsed: str) -> Column:
    return F.col(parsed).isNull() | F.col(f"{parsed}.{CORRUPT}").isNotNull()


def finish(items: DataFrame, name: str, columns: dict[str, Column]) -> DataFrame:
    """Project exploded elements (``seq, page_url, pos``) to the ads schema.

    The fields are settled, so that the filters which follow do not extract them
    from the page a second time.
    """
    where = sc.arrival(0, F.col("seq"), F.col("page_url"), F.col("pos"))
    given = {"source": F.lit(name), **columns, "arrival": where}
    filled = {
        f.name: sc.fill(f, given.get(f.name, F.lit(None))) for f in sc.ADS.fields
    }
    return sc.settle(items, filled).select(*sc.ADS.names)


def present(ads: DataFrame) -> DataFrame:
    """Rows with both a title and a URL."""
    return ads.filter((F.col("title") != "") & (F.col("url") != ""))


def fetched_pages(raw: DataFrame, name: str) -> DataFrame:
    """(source, page_url, ok) of pages that are read leniently, as cards and markdown are: only
    one that was not fetched, a null body, has failed."""
    return raw.select(F.lit(name).alias("source"), "page_url", F.col("body").isNotNull().alias("ok"))


def ingest_report(pages: DataFrame, ads: DataFrame) -> DataFrame:
    """Per source: pages read, pages failed, ads, and whether the source failed.

    ``pages`` has ``source, ok``. A source fails only when it gave no ad at all
    and some page of it could not be read.
    """
    tried = pages.groupBy("source").agg(
        F.count_if("ok").alias("pages_ok"), F.count_if(~F.col("ok")).alias("pages_failed")
    )
    given = ads.groupBy("source").agg(F.count(F.lit(1)).alias("ads"))
    joined = tried.join(given, "source", "full_outer").na.fill(0)
    return joined.withColumn("failed", (F.col("ads") == 0) & (F.col("pages_failed") > 0))

"""Input tables, the shared folder, and samples of labelled rows."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Where the tables of ``stored`` lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session without one (tests) gets a folder beside its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read back: computed once, lineage cut."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables. Only for ones that nothing reads any more: all that
    was derived from them must be stored itself."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32(doc_id as text) modulo ``divisor``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % divisor


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int
) -> DataFrame:
    """(text, label) of at most ``per_class`` learnable documents of each label value 0 and 1.

    The sample is the rows with the least hash of their id, so it does not depend on
    partitions. Only ids are broadcast, at most ``2 * per_class`` of them. Null labels and
    null texts are no examples; an id with several label rows counts once for each value, and
    of an id with several texts the least one is taken.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    known = known.where(learn & F.col("_id").isNotNull()).where("label IN (0, 1)").distinct()
    order = [F.xxhash64("_id"), F.col("_id")]
    kept = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(*order).limit(per_class)
        kept = part if kept is None else kept.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where("text IS NOT NULL")
    sample = texts.join(F.broadcast(kept), "_id").groupBy("_id", "label").agg(F.min("text").alias("text"))
    # few rows, but work for every task
    return sample.repartition(docs.sparkSession.sparkContext.defaultParallelism, "_id").select("_id", "text", "label")


def plus(schema: T.StructType, fields: str) -> T.StructType:
    """``schema`` with the fields of a DDL string behind it, as a new one."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(fields).fields])

"""Session helpers: where lineage is cut, and how a small input gets its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none, as in tests, is a folder beside its warehouse set.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    folder = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store rows that several later steps read, on storage that outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input over as many tasks as ``spark.listsieve.spread`` says; unset, as by
    default, it is left as it lies. For small tables in one file, where a single task would
    do all costly text work."""
    tasks = df.sparkSession.conf.get("spark.listsieve.spread", None)
    return df.repartition(int(tasks), *keys) if tasks else df

"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
as the next one's ``docs``. All but the last keep the columns of ``docs``, whatever they are.
Every stage takes null and repeated ids and texts as its operator does; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listsieve.llm import decontaminate, language_codes, near_join, packing, secret_index
from listsieve.llm.queries import WORD_BPE
from listsieve.llm.tables import new_path, remainder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or null, go, and so do those twice as far from every learnt language
    as any text of their size or longer that the model names rightly. The model is learned
    from the stage's own documents but for the held-out third; the distances are measured on that
    third, all of it. An ambiguous text stays: it is near two languages."""
    learn = F.coalesce(remainder("doc_id", 3) != 1, F.lit(True))
    known = docs.select("doc_id", "text", "lang")
    model = language_codes.fit(known, learn)
    if not model.languages:  # nothing to learn from: keep what has a letter
        return docs.where(F.col("text").rlike(r"\p{L}"))
    limits = language_codes.distance_limits(known.where(~learn), model)
    # the other columns travel in a struct, so that the operator's names replace none of them; the
    # text goes to the workers once
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("document"), "text")
    found = language_codes.identify(packed, model)
    told = (F.col("lang_pred") != language_codes.UNKNOWN) & language_codes.in_limits(limits)
    return found.where(told).select(*["text" if c == "text" else F.col("document")[c].alias(c) for c in docs.columns])


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays; where rows repeat
    that id and text, one of them. Documents without words are in no group and stay. A null id
    goes if its group has another one."""
    found = near_join.join(docs)
    return once_each(without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the ids and texts of ``rows`` (doc_id, text_hash)."""
    gone = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    return docs.join(gone, same, "left_anti")


def once_each(docs: DataFrame) -> DataFrame:
    """Rows of one id and text once; a null id is no repeat of another."""
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    repeats = keyed.groupBy("doc_id", "_text").count().where("count > 1 AND doc_id IS NOT NULL").drop("count")
    if repeats.isEmpty():
        return docs
    single = keyed.join(repeats, ["doc_id", "_text"], "left_anti")
    many = keyed.join(repeats, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
    return single.unionByName(many).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate.match(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blacked out, ``n_chars`` follows; every document stays."""
    found = secret_index.scan(docs)
    clean = secret_index.redact(F.col("text"), F.col("secret_spans"))
    found = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(F.size("secret_spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", counted)
    return found.select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, each in its sequence of at most 2048 ids."""
    return packing.pack(docs, end_id=1, **WORD_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("language_codes", keep_known_language),
    ("near_join", keep_one_of_alike),
    ("decontaminate", drop_contaminated),
    ("secret_index", redact_secrets),
    ("packing", pack_windows),
]

#: Packing ends in token ids, which SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

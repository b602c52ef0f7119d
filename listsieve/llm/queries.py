"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listsieve.llm import ball_search, decontaminate, fingerprints, language_codes, near_join, packing, pattern_packing, prefix_trie, quality_zstd, secret_index, token_files, tokens, toxicity, url_filter
from listsieve.llm.oracles import ORACLES  # noqa: F401  beside the queries they belong to
from listsieve.llm.tables import remainder, table

URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


#: The byte-level vocabulary: ids below 50257.
BYTE_BPE = {"path": tokens.public_path("byte_bpe_50k.json"), "blank_led": True}
#: The vocabulary with word ends.
WORD_BPE = {"path": tokens.public_path("word_bpe_49k.json"), "blank_led": False}


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = token_files.write(docs, "token-files", end_id=2, vocabulary=50_257, **BYTE_BPE)
    return token_files.documents(blocks)


def op2_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = secret_index.scan(docs)
    kinds = [rule.kind for rule in secret_index.BASE_RULES]
    base = F.filter("secret_spans", lambda s: s["kind"].isin(kinds))
    counts = [secret_index.count_of(F.col("secret_spans"), k).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_index.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_index.joined(F.col("secret_spans")).alias("spans"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, end_id=1, **WORD_BPE)


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = language_codes.fit(docs, ~held_out)
    found = language_codes.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.fit(url_filter.seed())
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, weights)


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.join(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    learn = F.coalesce(remainder("_id", 3) != 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # four ranges a shuffle partition, so that hashing evens them out
    rows = fingerprints.with_next(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("edited", fingerprints.edited_text(F.col("text"), F.col("next_text")))
    rows = fingerprints.with_sketch(rows, "edited", "changed")
    own = F.col("sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.encoded(own).alias("fingerprint"),
        fingerprints.encoded(F.col("changed")).alias("edited_fingerprint"),
        fingerprints.resemblance(own, F.col("changed")).alias("near_edited"),
        fingerprints.resemblance(own, F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(own).alias("distinct_shingles"),
        fingerprints.containment(own, F.col("changed")).alias("edited_has"),
    )


def op10_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    learn = F.coalesce(remainder("_id", 5) != 0, F.lit(False))
    model = quality_zstd.fit(docs, table(spark, sf_dir, "labels"), learn)
    return quality_zstd.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ball_search.search(docs, table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pattern_packing.pack(docs, end_id=0, **BYTE_BPE)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_secret_index": op2_secret_index,
    "op3_packing": op3_packing,
    "op4_language_codes": op4_language_codes,
    "op5_url_filter": op5_url_filter,
    "op6_near_join": op6_near_join,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_zstd": op10_quality_zstd,
    "op11_ball_search": op11_ball_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_pattern_packing": op13_pattern_packing,
}

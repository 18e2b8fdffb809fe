"""The registered queries of the training-data operators, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_counts, decontaminate, errata_trie, jaccard_join, lang_id, order_minhash, piece_lattice, prefix_trie, quality_rules, resample, sharding, suffix_dedup, toxicity
from .common import read_table

SHARDS = 40


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the cascade's verdict for every document."""
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds, as text."""
    found = decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join("item_ids", ","))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100).drop("t", "component_t")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations (as digests) with their scores, and the round trip of every document."""
    return piece_lattice.encode(read_table(spark, sf_dir, "documents"), "piece_bpe_32k.model", n=4, with_ids=False)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when repeated 200-byte strings go."""
    return suffix_dedup.removal_digest(read_table(spark, sf_dir, "documents"))


def crc32_of_id() -> Column:
    """Unsigned CRC-32 of the doc_id as text, by which the contracts deal out folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter is held out of training."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))
    model = lang_id.fit(docs, ~held_out)
    found = lang_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight of every document towards the texts labelled good, and whether the Gumbel top-k draw took it."""
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public piece_bpe_32k model."""
    return bpe_counts.token_counts(read_table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth is held out of training."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id() % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = sharding.kd_shards(read_table(spark, sf_dir, "documents"), shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return errata_trie.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every document and of its edited text, with their likeness and that to the next document."""
    return order_minhash.fingerprints(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_token_counts": op8_token_counts,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_order_minhash": op13_order_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op4_suffix_dedup": suffix_dedup.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_spelling_variants": errata_trie.SQL,
}

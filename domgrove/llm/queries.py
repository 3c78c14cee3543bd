"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domgrove.llm import (
    binary,
    conversations,
    decontaminate,
    merkle,
    near,
    ngram_join,
    oracles,
    packing,
    quality_classifier,
    quality_rules,
    substring,
    suffixes,
    token_counts,
    toxicity,
)
from domgrove.llm.common import documents, table


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.write_shards(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(documents(spark, sf_dir)).drop("spans")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_words(documents(spark, sf_dir)).drop("spans")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_suffix_dedup, op3_decontamination, op4_packing, op5_quality_rules, op6_quality_classifier,
    op7_near_dedup, op8_substring_dedup, op9_token_ids, op10_toxicity, op11_ngram_join, op12_conversation_trie, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op2_suffix_dedup": oracles.OP2, "op7_near_dedup": oracles.OP7, "op8_substring_dedup": oracles.OP8,
                           "op11_ngram_join": oracles.OP11, "op12_conversation_trie": oracles.OP12, "op13_merkle_manifest": oracles.OP13}

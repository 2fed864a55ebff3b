"""The queries opN_<name> over the synthetic tables and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import bpe, centroids, chosen_path, hash_tree, oracles, quality, secrets, separators, substrings, templates, tool_calls
from nodeloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_chosen_path": oracles.near_duplicates(3, 85), "op5_quality_rules": oracles.quality(), "op9_substring_dedup": oracles.substrings()}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judged(table(spark, sf_dir, "documents")).select(columns)


@_query
def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = hash_tree.tree(40)
    return hash_tree.placed(table(spark, sf_dir, "documents"), root, hash_tree.grown(root, 40))


@_query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = centroids.learn(docs)
    return centroids.identified(docs, model).withColumn("held_out", centroids.held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.grouped(table(spark, sf_dir, "documents"), width=3, at_least=85)


@_query
def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_turns(table(spark, sf_dir, "conversations"))


@_query
def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = separators.counted(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "terminated")

"""The ten operators applied to the tables of a scale-factor directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import chat_tree, knn, lm_scoring, mixing, packing, quality, simhash, substring_dedup, token_counts, token_files
from sluice.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_tree.digests(rows.unionByName(chat_tree.probe(spark)))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), "web-2")
    base = quality.passes("base-1")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & F.col("kept")).alias("kept"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps, whole (``without`` is empty) and without each of its rules."""
    kept = quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))
    return kept.withColumn("without", F.coalesce("without", F.lit("")))


def op7_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_substring_dedup,
        op3_nnls_packing,
        op4_chat_trees,
        op5_source_mixing,
        op6_quality_rules,
        op7_voronoi_knn,
        op8_token_counts,
        op9_simhash,
        op10_token_files,
        rule_ablations,
    )
}

#: The others need a tokenizer, a fingerprint function or an iteration that SQL doesn't have.
ORACLES: dict[str, str] = {
    "op1_lm_scoring": lm_scoring.ORACLE_SQL,
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_chat_trees": chat_tree.ORACLE_SQL,
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "rule_ablations": quality.ABLATIONS_SQL,
    "op7_voronoi_knn": knn.ORACLE_SQL,
}

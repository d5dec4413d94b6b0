"""Registered queries of the text operators: production parameters, whole tables, contract columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import (
    lattice_dedup, license_scan, line_templates, piece_codec, quality_rules, role_repair, simhash, source_audit, source_mix, suffix_dedup,
    suffix_trees, token_counts, toxicity,
)
from lumenlake.llm.common import load

# Tokenizer files are named, never copied.
PIECES = "piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return piece_codec.digests(coded)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_templates.drop_recurring(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(load(spark, sf_dir, "documents")).drop("failed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(load(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_trees.remove_repeats(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair_damaged(load(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_license_scan": op2_license_scan,
        "op3_simhash": op3_simhash,
        "op4_line_dedup": op4_line_dedup,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_source_mix": op10_source_mix,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the operator over whole tables."""
    return {
        "op2_license_scan": license_scan.SQL,
        "op4_line_dedup": line_templates.SQL,
        "op7_quality_rules": quality_rules.SQL,
        "op10_source_mix": source_mix.SQL,
        "op11_substring_dedup": suffix_trees.SQL,
        "op13_source_divergence": source_audit.SQL,
    }

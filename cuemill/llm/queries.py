"""Queries over the corpus tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm import bpe, compression, decontaminate, divergence, infill, jaccard, language, language_model, license_scan, oracles, pii, quality, secrets, token_files
from cuemill.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_in(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = compression.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_secret_scan, op3_pii, op4_byte_bpe, op5_ngram_jaccard_join, op6_language_id, op7_token_files, op8_license_scan, op9_stupid_backoff, op10_quality_rules, op11_compression_quality, op12_fill_in_middle, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard_join": oracles.JACCARD, "op9_stupid_backoff": oracles.BACKOFF, "op10_quality_rules": oracles.QUALITY, "op12_fill_in_middle": oracles.INFILL, "op13_source_divergence": oracles.DIVERGENCE}

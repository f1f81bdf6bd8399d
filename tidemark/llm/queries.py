"""The operators' queries: each applies one operator to the whole of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, crf, lexical, licenses, media, mixing, rules, runs, secrets, simhash, tokenfile, toxicity, vectors
from .shared import documents, labels


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_report(documents(spark, sf_dir))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_verdicts(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"most_{m}" for m in rules.METRICS)
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_report(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_report(documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan,
        op2_bpe,
        op3_line_crf,
        op4_media_columns,
        op5_mixing,
        op6_simhash,
        op7_quality_rules,
        op8_token_files,
        op9_license_scan,
        op10_toxicity,
        op11_periodic_runs,
        op12_lexical_search,
        op13_embedding_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": rules.ORACLE_SQL, "op12_lexical_search": lexical.ORACLE_SQL, "op13_embedding_dedup": vectors.ORACLE_SQL}

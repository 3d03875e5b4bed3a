"""The operators applied to the synthetic tables, one query each.

``QUERIES`` maps a name to a callable of (spark, folder); ``ORACLES`` has SQL for
those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, importance, lang_id, license, line_dedup, lm, mixing, near_dup, quality, spelling, substring, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.digest(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(_table(spark, sf_dir, "pages"))


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"))


def op7_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(_table(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_source_mixing": op2_source_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_quality_divergence": op4_quality_divergence,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe": op6_bpe,
    "op7_phrase_fingerprint": op7_phrase_fingerprint,
    "op8_license_scan": op8_license_scan,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_near_dup": op10_near_dup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op2_source_mixing": mixing.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op4_quality_divergence": quality.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_substring_dedup": substring.ORACLE,
}

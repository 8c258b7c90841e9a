"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language, licenses, media, mixing, ngram_join, oracle, pitman_yor, secret_scan, sharding, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": pitman_yor.op1_lm_scoring,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_mixing": mixing.op4_mixing,
        "op5_sharding": sharding.op5_sharding,
        "op6_language_id": language.op6_language_id,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_media_columns": media.op8_media_columns,
        "op9_decontamination": decontamination.op9_decontamination,
        "mixing_targets": mixing.mixing_targets,
        "ngram_sizes": ngram_join.ngram_sizes,
        "media_payloads": media.media_payloads,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)

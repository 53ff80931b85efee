"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, licenses, media, mixing, oracles, quality, secrets, simhash_dedup, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_simhash": simhash_dedup.op2_simhash,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_licenses": licenses.op4_licenses,
        "op5_media": media.op5_media,
        "op6_secrets": secrets.op6_secrets,
        "op7_chat": chat.op7_chat,
        "op8_quality": quality.op8_quality,
        "op9_mixing": mixing.op9_mixing,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

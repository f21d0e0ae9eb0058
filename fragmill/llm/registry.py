"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, licenses, mixing, oracles, order_minhash, phrases, pii, ppm, quality, shingle_join, suffixes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.query,
        "op2_order_minhash": order_minhash.query,
        "op3_surrogates": pii.query,
        "op4_ppm": ppm.query,
        "op5_source_mix": mixing.query,
        "op6_risk_rules": quality.query,
        "op7_suffix_dedup": suffixes.query,
        "op8_byte_bpe": bpe.query,
        "op9_shingle_join": shingle_join.query,
        "op10_phrase_dedup": phrases.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_dedup": oracles.SUFFIXES, "op9_shingle_join": oracles.SHINGLES, "op10_phrase_dedup": oracles.PHRASES}

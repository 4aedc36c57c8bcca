"""Queries of this folder and their SQL, for the driver's entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, infill, mixing, ngram_join, ogg, preference, repair, resampling, token_counts, toxicity, warc, wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        preference.op1_preference_format,
        token_counts.op2_token_counts,
        resampling.op3_importance_resample,
        ngram_join.op4_ngram_join,
        wavelet.op5_wavelet_token_ids,
        ogg.op6_ogg_media,
        decontaminate.op7_decontaminate,
        warc.op8_warc,
        toxicity.op9_toxicity,
        mixing.op10_temperature_mix,
        infill.op11_fill_in_middle,
        bpe.op12_bpe,
        repair.op13_conversation_repair,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_preference_format": preference.OP1_SQL,
        "op4_ngram_join": ngram_join.OP4_SQL,
        "op8_warc": warc.OP8_SQL,
        "op10_temperature_mix": mixing.OP10_SQL,
        "op11_fill_in_middle": infill.OP11_SQL,
        "op13_conversation_repair": repair.OP13_SQL,
    }

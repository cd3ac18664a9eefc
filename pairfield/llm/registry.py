"""The queries of this subpackage and their DuckDB SQL, where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, media, mixing, pii, quality, simhash, substrings, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_mixing": mixing.op2_mixing,
        "op3_media": media.op3_media,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_substrings": substrings.op5_substrings,
        "op6_quality": quality.op6_quality,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_simhash": simhash.op8_simhash,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_html": html.op10_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op5_substrings": substrings.SQL}

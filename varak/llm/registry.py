"""Queries over the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, html_text, langid, mixing, quality_rules, recompression, sharding, simhash, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_toxicity": toxicity.query,
        "op3_sharding": sharding.query,
        "op4_quality_rules": quality_rules.query,
        "op5_langid": langid.query,
        "op6_html_text": html_text.query,
        "op7_decontamination": decontamination.query,
        "op8_simhash": simhash.query,
        "op9_url_filter": url_filter.query,
        "op10_recompression": recompression.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.SQL, "op9_url_filter": url_filter.SQL, "op10_recompression": recompression.SQL}

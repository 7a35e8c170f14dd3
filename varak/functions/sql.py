"""The text functions under names that SQL can use.

They are SQL functions of the session, so Catalyst inlines them: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from varak.functions.text import NOT_LETTER, NOT_WS, REPAIR_SIGNS, WORD, WS


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _functions() -> dict[str, tuple[str, str, str]]:
    """name: parameters, type, body."""
    clean = f"lower(trim(regexp_replace(t, {_quoted(f'{NOT_LETTER}+')}, ' ')))"
    both = "size(array_intersect(x, y))"
    score = f"CASE WHEN size(x) > 0 AND size(y) > 0 THEN {both} / (size(x) + size(y) - {both}) ELSE 0.0D END"
    marks = " OR ".join(f"t RLIKE {_quoted('(?U)' + p)}" for p in REPAIR_SIGNS.values())
    return {
        "strip_space": ("t STRING", "STRING", f"regexp_replace(t, {_quoted(f'(?U)^{WS}+|{WS}+$')}, '')"),
        "word_count": ("t STRING", "BIGINT", f"CAST(regexp_count(t, {_quoted(f'(?U){NOT_WS}+')}) AS BIGINT)"),
        "sentence_count": ("t STRING", "BIGINT", f"CAST(regexp_count(t, {_quoted(f'(?U){WORD}[.!?](?:{WS}|\\z)')}) AS BIGINT)"),
        "clean_text": ("t STRING", "STRING", clean),
        "word_set": ("t STRING", "ARRAY<STRING>", f"array_remove(array_distinct(split({clean}, ' ')), '')"),
        "set_similarity": ("x ARRAY<STRING>, y ARRAY<STRING>", "DOUBLE", score),
        "needs_correction": ("t STRING", "BOOLEAN", marks),
    }


def register(spark: SparkSession, prefix: str = "varak_") -> list[str]:
    """Define the functions in the session and return their names."""
    for name, (parameters, kind, body) in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in _functions()]

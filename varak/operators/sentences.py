"""Sentence flags and repair with an injected corrector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varak.functions import vector as V
from varak.functions.text import REPAIR_SIGNS, let, line_sentences

#: Takes a batch of sentences and returns as many corrected ones; None where one failed.
Corrector = Callable[[list[str]], list[str | None]]


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a sentence: id, line_idx, sent_idx, sentence. A blank line has one empty sentence."""
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_idx", "_line"))
    cut = lines.select(id_col, "line_idx", F.posexplode(line_sentences(F.col("_line"))).alias("sent_idx", "sentence"))
    return cut.select(id_col, F.col("line_idx").cast("long"), F.col("sent_idx").cast("long"), "sentence")


def _signs_of(batch: pd.Series) -> pd.DataFrame:
    """Signs of each sentence; null for a null one."""
    texts, given = batch.tolist(), batch.notna().to_numpy()
    if given.all():
        return pd.DataFrame(V.signs(texts))
    found = {}
    for name, flags in V.signs([t for t in texts if t is not None]).items():
        found[name] = np.full(len(texts), None, object)
        found[name][given] = flags
    return pd.DataFrame(found)


def _all_signs():
    """Sentences to the signs of each."""

    @F.pandas_udf(", ".join(f"{name} boolean" for name in (*REPAIR_SIGNS, "needs_correction")))
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _signs_of(batch)

    return call


def _once(rows: DataFrame, call, *columns: Column) -> DataFrame:
    """Add what a Python function finds as column _found. As if it weren't deterministic: filters that follow would call it
    once more."""
    return rows.withColumn("_found", call.asNondeterministic()(*columns))


def flag_sentences(rows: DataFrame, sentence_col: str = "sentence") -> DataFrame:
    """Add one boolean column for each repair sign, and needs_correction, which is any of them."""
    found = _once(rows, _all_signs(), F.col(sentence_col))
    return found.select(*rows.columns, *[F.col(f"_found.{name}").alias(name) for name in (*REPAIR_SIGNS, "needs_correction")])


def _asked(corrector: Corrector, texts: list[str]) -> list[str | None]:
    """What the corrector makes of the texts; where it fails for the batch, they are tried one by one."""
    try:
        found = list(corrector(texts)) if texts else []
        if len(found) != len(texts):
            raise ValueError("a corrector returns as many texts as it gets")
        return found
    except Exception:
        return [_alone(corrector, t) for t in texts]


def _repairer(corrector: Corrector | None):
    """Sentences to their corrected forms, null where none was made, and their cleanliness."""

    @F.pandas_udf("fixed string, cleanliness double")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t for t in batch if t is not None]
            due = V.signs(texts)["needs_correction"].tolist()
            flagged = [t for t, flag in zip(texts, due) if flag]
            raw = iter(flagged if corrector is None else _asked(corrector, flagged))
            flags = iter(due)
            fixed, clean = [], []
            for t in batch:
                if t is None or not next(flags):
                    fixed.append(None)
                    clean.append(1.0)
                elif (found := next(raw)) is None:
                    fixed.append(None)
                    clean.append(0.0)
                else:
                    fixed.append(V.post_process(found))
                    clean.append(V.cleanliness(t, fixed[-1]))
            yield pd.DataFrame({"fixed": pd.Series(fixed, dtype=object), "cleanliness": pd.Series(clean, dtype="float64")})

    return call


def repair(rows: DataFrame, corrector: Corrector | None = None, sentence_col: str = "sentence") -> DataFrame:
    """Add corrected, cleanliness and was_corrected to sentences.

    Only flagged sentences reach the corrector (default: the identity). A sentence that isn't flagged stays as it is, with
    cleanliness 1; one whose correction failed stays too, with cleanliness 0. A sentence is looked at once, in batches.
    """
    found = _once(rows, _repairer(corrector), F.col(sentence_col))
    return found.select(
        *rows.columns,
        F.coalesce("_found.fixed", F.col(sentence_col)).alias("corrected"),
        F.col("_found.cleanliness").alias("cleanliness"),
        F.col("_found.fixed").isNotNull().alias("was_corrected"),
    )


def _alone(corrector: Corrector, text: str) -> str | None:
    try:
        return corrector([text])[0]
    except Exception:
        return None


def _list_repairer(corrector: Corrector | None):
    """Arrays of sentences to those with the flagged ones corrected; a null array stays."""

    @F.pandas_udf("array<string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t for items in batch if items is not None for t in items]
            due = V.signs(texts)["needs_correction"].tolist()
            flagged = [t for t, flag in zip(texts, due) if flag]
            raw = iter(flagged if corrector is None else _asked(corrector, flagged))
            flags = iter(due)
            yield pd.Series([None if items is None else [_fixed(t, next(raw)) if next(flags) else t for t in items] for items in batch], dtype=object)

    return call


def _fixed(text: str, found: str | None) -> str:
    return text if found is None else V.post_process(found)


def correct_texts(docs: DataFrame, corrector: Corrector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with its flagged sentences corrected, put together again: id, text.

    A sentence is followed by a blank, a line by a line break. Every text is taken apart and rebuilt in its own row, so
    nothing is shuffled and ids may repeat or be null. A null text stays null.
    """

    def with_ends(line: Column) -> Column:
        return let(line_sentences(line), lambda own: F.transform(own, lambda s, i: F.struct(s.alias("s"), F.when(i == F.size(own) - 1, F.lit(" \n")).otherwise(F.lit(" ")).alias("end"))))

    parts = docs.select(id_col, F.flatten(F.transform(F.split(F.col(text_col), "\n"), with_ends)).alias("_parts"))
    fixed = _once(parts, _list_repairer(corrector), F.col("_parts.s"))
    return fixed.select(id_col, F.array_join(F.zip_with("_found", "_parts", lambda s, x: F.concat(s, x["end"])), "").alias("text"))

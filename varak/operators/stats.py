"""Corpus statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varak.functions import vector as V
from varak.functions.text import char_count, report_sentences, sentence_count, word_count

#: Takes texts and returns their token counts. Tokens are never guessed from words.
TokenCounter = Callable[[list[str]], list[int]]


def token_count(text: Column, counter: TokenCounter | None) -> Column:
    if counter is None:
        return F.lit(None).cast("long")

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(counter(batch.fillna("").tolist()), dtype="int64")

    return count(text)


def bpe_counter(rank_file: str, pattern: str) -> TokenCounter:
    """Token counts by a byte-pair encoding whose rank file (lines of base64 token and rank) every executor can read; loaded
    once a worker."""
    loaded = {}

    def count(texts: list[str]) -> list[int]:
        if "e" not in loaded:
            import base64

            import tiktoken

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            loaded["e"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return [len(t) for t in loaded["e"].encode_ordinary_batch(texts, num_threads=1)]

    return count


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counter: TokenCounter | None = None) -> DataFrame:
    """Per text: id, tokens (null without a counter), sentences, words, characters."""
    text = F.col(text_col)
    return docs.select(id_col, token_count(text, counter).alias("tokens"), sentence_count(text).alias("sentences"), word_count(text).alias("words"), char_count(text).alias("characters"))


def totals(stats: DataFrame) -> DataFrame:
    """One row: sums of tokens, sentences, words, characters, and files_processed. Sums over no rows are 0."""
    names = ("tokens", "sentences", "words", "characters")
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names], F.count("*").alias("files_processed"))


_COUNTS = [f"{side}_{n}" for side in ("original", "corrected") for n in ("tokens", "characters", "sentences", "sentence_words")]


def _both_sides(original: Column, corrected: Column) -> Column:
    """The counts of both texts, which aren't null."""

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([V.report_counts(x) + V.report_counts(y) for x, y in zip(a, b)], columns=_COUNTS, dtype="int64")

    return count(original, corrected)


def repair_report(repaired: DataFrame, sentence_col: str = "sentence") -> DataFrame:
    """One row over the corrected sentences: counts of tokens (words), characters and sentences of both sides, their
    differences, average words a sentence, and average, least and most cleanliness; averages over nothing are null.
    """
    kept = repaired.where("was_corrected")
    both, names = ("original", "corrected"), ("tokens", "characters", "sentences")
    flat = kept.select("cleanliness", _both_sides(F.col(sentence_col), F.col("corrected")).alias("_n")).select("cleanliness", "_n.*")
    sums = flat.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS], *[f("cleanliness").alias(f"{a}_cleanliness") for a, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    counted = [f"{s}_{n}" for s in both for n in names]
    differ = [(F.col(f"original_{n}") - F.col(f"corrected_{n}")).alias(f"difference_{n}") for n in names]
    average = [F.when(F.col(f"{s}_sentences") > 0, F.col(f"{s}_sentence_words") / F.col(f"{s}_sentences")).alias(f"{s}_words_per_sentence") for s in both]
    return sums.select(*counted, *differ, *average, "avg_cleanliness", "min_cleanliness", "max_cleanliness")


def report_text(report: DataFrame) -> DataFrame:
    """The numbers of repair_report() as text, one row: value. Averages have two places; those over nothing are a dash."""

    def two(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))).otherwise("-")

    lines = [F.lit("Sentence repair"), F.lit("")]
    for title, name in (("Tokens", "tokens"), ("Characters", "characters"), ("Sentences", "sentences")):
        lines.append(F.format_string(f"{title}: %d before, %d after, %d fewer", F.col(f"original_{name}"), F.col(f"corrected_{name}"), F.col(f"difference_{name}")))
    lines.append(F.concat(F.lit("Words a sentence: "), two("original_words_per_sentence"), F.lit(" before, "), two("corrected_words_per_sentence"), F.lit(" after")))
    lines.append(F.concat(F.lit("Cleanliness: "), two("avg_cleanliness"), F.lit(" on average, "), two("min_cleanliness"), F.lit(" to "), two("max_cleanliness")))
    return report.select(F.concat_ws("\n", *lines).alias("value"))


def words_per_sentence(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Histogram: n_words of a report sentence, and how many sentences have so many."""
    return docs.select(F.explode(report_sentences(F.col(text_col))).alias("s")).groupBy(word_count(F.col("s")).alias("n_words")).agg(F.count("*").alias("n_sentences"))


def cleanliness_histogram(repaired: DataFrame, bins: int = 20) -> DataFrame:
    """How many corrected sentences fall into each of bins equal parts of 0 to 1; 1 belongs to the last."""
    bin_ = F.least(F.floor(F.col("cleanliness") * bins), F.lit(bins - 1)).cast("long")
    return repaired.where("was_corrected").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n_sentences"))

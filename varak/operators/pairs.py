"""Mining of original and translation pairs: narrow array expressions, one stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varak.functions.text import fair_lengths, let, similarity_of_sets, strip, word_set

PAIR = "array<struct<original:string,translation:string,similarity:double,pair_type:string,metadata:map<string,string>>>"


def _scored(original: Column, translation: Column, kind: str) -> Column:
    """A pair with its similarity, computed once; null similarity where the lengths already rule it out."""
    fair = F.when(fair_lengths(original, translation), let(word_set(original), lambda a: let(word_set(translation), lambda b: similarity_of_sets(a, b))))
    return F.struct(
        original.alias("original"), translation.alias("translation"), fair.alias("similarity"), F.lit(kind).alias("pair_type"), F.lit(None).cast("map<string,string>").alias("metadata")
    )


def _at_least(pairs: Column, threshold: float) -> Column:
    return F.filter(pairs, lambda p: p["similarity"] >= threshold)


def poetic_pairs(paragraph: Column) -> Column:
    """Lines 1 and 2, 3 and 4, ... of a stanza; blank lines keep their place, an odd last line is left out."""

    def of(lines: Column) -> Column:
        couples = F.transform(F.sequence(F.lit(0), F.floor(F.size(lines) / 2).cast("int") - 1), lambda i: _scored(strip(F.get(lines, 2 * i)), strip(F.get(lines, 2 * i + 1)), "poetic"))
        return F.when(F.size(lines) >= 2, _at_least(couples, 0.2)).otherwise(F.array().cast(PAIR))

    return let(F.split(paragraph, "\n"), of)


def direct_pairs(paragraphs: Column, min_similarity: float = 0.3) -> Column:
    """Each stripped paragraph and the next, where that one stands between underscores."""

    def of(ps: Column) -> Column:
        n = F.size(ps)
        bare = lambda p: strip(F.btrim(p, F.lit("_")))
        starts = F.filter(F.sequence(F.lit(0), n - 2), lambda i: (F.get(ps, i) != "") & F.get(ps, i + 1).startswith("_") & F.get(ps, i + 1).endswith("_"))
        found = F.transform(starts, lambda i: _scored(F.get(ps, i), bare(F.get(ps, i + 1)), "direct_pair"))
        return F.when(n >= 2, _at_least(found, min_similarity)).otherwise(F.array().cast(PAIR))

    return let(paragraphs, of)


def extract_pairs(text: Column, min_similarity: float = 0.3, all_paragraphs: bool = False) -> Column:
    """All pairs of a text: direct ones in order, then the couplets of its last paragraph.

    Couplets are held to 0.2 whatever min_similarity says; verify_pairs() applies one threshold to all. With
    all_paragraphs (an extension) couplets are sought in every paragraph that has no translation after it.
    """

    def of(ps: Column) -> Column:
        last = F.get(ps, F.size(ps) - 1)
        if not all_paragraphs:
            return F.concat(direct_pairs(ps, min_similarity), poetic_pairs(last))
        translated = lambda i: F.coalesce(F.get(ps, i + 1).startswith("_") & F.get(ps, i + 1).endswith("_"), F.lit(False))
        return F.concat(direct_pairs(ps, min_similarity), F.flatten(F.transform(ps, lambda p, i: F.when(translated(i), F.array().cast(PAIR)).otherwise(poetic_pairs(p)))))

    return let(F.transform(F.split(text, "\n\n"), strip), of)


def mine_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_similarity: float = 0.3, all_paragraphs: bool = False) -> DataFrame:
    """One row a pair: id, pair_idx, original, translation, similarity, pair_type, metadata (always null)."""
    found = docs.select(id_col, F.posexplode(extract_pairs(F.col(text_col), min_similarity, all_paragraphs)).alias("pair_idx", "_p"))
    return found.select(id_col, F.col("pair_idx").cast("long"), "_p.*")


def verify_pairs(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The pairs of at least the similarity."""
    return pairs.where(F.col("similarity") >= threshold)

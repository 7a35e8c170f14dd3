"""Benchmark decontamination: close word pairs, then Smith-Waterman alignment.

The items are the query set, taken in blocks of bounded size; every block is laid against all documents in one pass.
A pair is two words next to each other or with one word between. A match adds 2 to an alignment's score and an error
takes 1, so the score is at most 2 (the last match), plus 2 for every two matches in a row, plus 1 for every two matches
that one error parts; two or more errors outweigh a match. All but 2 of the score thus comes from pairs that item and
document share, and an alignment above 0 covers less than three words of the document for each of the item. Only
stretches with enough shared pairs are aligned, which loses nothing against aligning every item with every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StructField, StructType

from .common import cut, table

MATCH, MISMATCH, GAP = 2, -1, -1
#: A document is contaminated by an item if the best alignment reaches this share of a full copy's score, or this score.
THRESHOLD, LONG_SCORE = 0.4, 24
#: Of a short item, a share of THRESHOLD would be a common phrase: it must reach SHORT_SHARE of its score, or SHORT_SCORE.
SHORT_SHARE, SHORT_SCORE = 0.8, 14
#: Bytes of item text that one block may hold; more items mean more blocks, each laid against all documents.
BLOCK_BYTES = 8 << 20
#: Shared pairs of one document that are held at a time.
HELD_PAIRS = 1 << 22
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def least_scores(sizes: np.ndarray, threshold: float, long_score: int) -> np.ndarray:
    """The score from which an alignment with an item of so many words is contamination."""
    full = MATCH * np.asarray(sizes)
    return np.minimum(np.maximum(threshold * full, np.minimum(SHORT_SHARE * full, SHORT_SCORE)), long_score)


class Items:
    """A block of items: vocabulary, item words as numbers, and the items that own each pair of words."""

    def __init__(self, items: list[tuple]):
        self.ids, self.vocab, self.words = [], {}, []
        for item_id, text in items:
            own = tokens(text)
            if own:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in own], dtype=np.int64))
        self.sizes = np.array([len(own) for own in self.words], dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        found = [(k, gap, self.pairs(own, gap)[1]) for k, own in enumerate(self.words) for gap in (1, 2)]
        code = np.concatenate([none, *[c for _, _, c in found]])
        owner = np.concatenate([none, *[np.full(len(c), k) for k, _, c in found]])
        apart = np.concatenate([none, *[np.full(len(c), gap) for _, gap, c in found]])
        order = np.lexsort((apart, owner, code))
        code, owner, apart = code[order], owner[order], apart[order]
        fresh = np.ones(len(code), dtype=bool)
        fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        self.owner, self.apart = owner[fresh], apart[fresh]
        self.codes, first = np.unique(code[fresh], return_index=True)
        self.first = np.append(first, len(self.owner))

    def numbers(self, text: str | None) -> np.ndarray:
        own = tokens(text)
        return np.fromiter(map(self.vocab.get, own, repeat(-1)), dtype=np.int64, count=len(own))

    def pairs(self, numbers: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, codes) of the pairs of known words that are gap words apart."""
        a, b = numbers[:-gap], numbers[gap:]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        return at, a[at] * len(self.vocab) + b[at]

    def shared(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, position, most that the pair adds to a score) of the pairs that text and items share, by item and
        position, each once; a part of the items at a time if there are too many."""
        at, slot, gap = [], [], []
        for g in (1, 2):
            p, code = self.pairs(numbers, g)
            if len(p) and len(self.codes):
                s = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = np.flatnonzero(self.codes[s] == code)
                at.append(p[hit])
                slot.append(s[hit])
                gap.append(np.full(len(hit), g))
        if not at or not sum(map(len, at)):
            return
        at, slot, gap = map(np.concatenate, (at, slot, gap))
        count = self.first[slot + 1] - self.first[slot]
        upto = np.cumsum(count)
        parts = int(1 + upto[-1] // HELD_PAIRS)
        cuts = np.unique(np.searchsorted(upto, np.arange(1, parts) * HELD_PAIRS))
        for part in range(parts):
            held = []
            for some in np.split(np.arange(len(at)), cuts) if parts > 1 else [slice(None)]:
                n = count[some]
                place = np.repeat(self.first[slot[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                item, p, close = self.owner[place], np.repeat(at[some], n), (self.apart[place] == 1) & (np.repeat(gap[some], n) == 1)
                own = slice(None) if parts == 1 else item % parts == part
                held.append((item[own], p[own], 1 + close[own]))
            item, p, worth = (np.concatenate(x) for x in zip(*held)) if parts > 1 else held[0]
            order = np.lexsort((-worth, p, item))
            item, p, worth = item[order], p[order], worth[order]
            fresh = np.ones(len(item), dtype=bool)
            fresh[1:] = (item[1:] != item[:-1]) | (p[1:] != p[:-1])
            yield item[fresh], p[fresh], worth[fresh]

    def stretches(self, numbers: np.ndarray, least: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By item, the stretches of the text that hold every alignment of at least that item's score."""
        out = {k: [(0, len(numbers))] for k in np.flatnonzero(least <= 2).tolist()}  # here one word would do
        for item, p, worth in self.shared(numbers):
            span = 3 * self.sizes[item]
            key = item * (len(numbers) + 3 * int(self.sizes.max()) + 1) + p
            total = np.concatenate([[0], np.cumsum(worth)])
            enough = total[np.searchsorted(key, key + span, side="right")] - total[:-1] >= least[item] - 2
            for k, low, high in zip(item[enough].tolist(), p[enough].tolist(), (p + span)[enough].tolist()):
                own = out.setdefault(k, [])
                if own and low <= own[-1][1]:
                    own[-1] = (own[-1][0], max(high, own[-1][1]))
                else:
                    own.append((low, high))
        return out


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman with linear gaps: (best score, index in part just after the alignment)."""
    offsets = np.arange(len(part) + 1) * -GAP
    row, best, end = np.zeros(len(part) + 1, dtype=np.int64), 0, 0
    for w in item:
        fresh = np.zeros_like(row)
        fresh[1:] = np.maximum(row[:-1] + np.where(part == w, MATCH, MISMATCH), 0)
        fresh = np.maximum(fresh, row + GAP)
        row = np.maximum.accumulate(fresh + offsets) - offsets
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def most(item: np.ndarray, part: np.ndarray) -> int:
    """At least the alignment's score: the best stretch of part if every word that the item has somewhere matched."""
    total = np.concatenate([[0], np.cumsum(np.where(np.isin(part, item), MATCH, MISMATCH))])
    return int((total - np.minimum.accumulate(total)).max())


def matches(items: Items, text: str | None, threshold: float, long_score: int) -> list[tuple]:
    """(item id, score, first word, word after the last) of each item that contaminates the text."""
    numbers = items.numbers(text)
    out = []
    least = least_scores(items.sizes, threshold, long_score)
    for k, parts in sorted(items.stretches(numbers, least).items()):
        item = items.words[k]
        n, best = len(item), (0, 0, 0)
        for low, high in parts:
            if most(item, numbers[low:high]) < least[k]:
                continue
            score, end = align(item, numbers[low:high])
            if score > best[0]:
                best = (score, low, low + end)
        score, low, stop = best
        if score and score >= least[k]:
            back = align(item[::-1], numbers[low:stop][::-1])[1]
            out.append((items.ids[k], score / (MATCH * n), stop - back, stop))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[Items]]:
    """The items in blocks of about BLOCK_BYTES of text: how many, and an iterator that reads one at a time."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    slot = F.pmod(F.xxhash64("i", "t"), F.lit(n))

    def read() -> Iterator[Items]:
        for b in range(n):
            items = Items(sorted(((r["i"], r["t"]) for r in rows.where(slot == b).collect()), key=lambda x: (x[0] is None, x[0], x[1])))
            if items.ids:
                yield items

    return n, read()


def _aligner(items: Items, threshold: float, long_score: int, schema: ArrayType):
    @F.pandas_udf(schema)
    def aligned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "score", "first_word", "end_word"), m)) for m in matches(items, t, threshold, long_score)] for t in texts])

    return aligned


def hits(items: Items, kind: DataType, text_col: str, threshold: float, long_score: int) -> Column:
    """A column of the documents: the array of the items of one block that contaminate its text."""
    schema = ArrayType(StructType([StructField("item_id", kind), StructField("score", DoubleType()), StructField("first_word", LongType()), StructField("end_word", LongType())]))
    return _aligner(items, threshold, long_score, schema)(F.col(text_col))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, long_score: int = LONG_SCORE,
) -> DataFrame:
    """One row for each document and item that contaminates it: id, item_id, score (1: full copy), first_word, end_word.

    Words are lower-cased and cut at white space and ASCII punctuation; first_word and end_word count them from 0.
    Null texts, null items and items without a word match nothing; items of up to 3 words must be there whole. Ids may be null or repeat: each row is judged by its own whole text. Empty tables give no rows.
    """
    kind = benchmark.schema[item_id].dataType
    names = ("item_id", "score", "first_word", "end_word")
    n, blocks = item_blocks(benchmark, item_id, item_text)
    parts = []
    for items in blocks:
        found = docs.select(F.col(id_col), F.explode(hits(items, kind, text_col, threshold, long_score)).alias("_m"))
        found = found.select(id_col, *[F.col(f"_m.{c}").alias(item_id if c == "item_id" else c) for c in names])
        parts.append(cut(found) if n > 1 else found)  # so that the driver holds one block at a time
    if not parts:
        return docs.select(F.col(id_col), F.lit(None).cast(kind).alias(item_id), F.lit(0.0).alias("score"), *[F.lit(0).cast("long").alias(c) for c in names[2:]]).limit(0)
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, long_score: int = LONG_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates. Null and empty texts are clean."""
    n, blocks = item_blocks(benchmark, item_id, item_text)
    kept = docs
    for items in blocks:
        kept = kept.where(F.size(hits(items, benchmark.schema[item_id].dataType, text_col, threshold, long_score)) == 0)
        kept = cut(kept) if n > 1 else kept
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. The words of a sentence, and the beginnings of words, give it a probability; a sentence
with none of the model's features has none. A document is toxic unless every sentence is harmless:
1 - (1 - leak) * product(1 - p). Only document labels are needed; the sentence scores then locate the offending ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: The model is fitted on about this many labelled documents, chosen by a hash of the id: at their own shares if those
#: give LEAST_TOXIC toxic ones, else toxic and harmless ones apart, half of it each. Of an id with several texts one is read.
#: The model has at most MAX_FEATURES, those that speak most surely for toxicity: by SURE standard errors of their log-odds,
#: and fewer where there are under 100 toxic documents.
FIT_ROWS, LEAST_TOXIC, MAX_FEATURES, SURE = 8000, 400, 4000, 3.0
PREFIXES = (4, 5, 6, 7)
#: Byte for byte: A-Z to a-z, sentence ends to a line break, other ASCII that isn't a letter or digit to a blank.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 10 if chr(c) in ".!?\n" else 32 for c in range(256)
)


def features_of(word: bytes) -> list[bytes]:
    """The word and, marked by a trailing *, its beginnings."""
    return [word, *[word[:k] + b"*" for k in PREFIXES if len(word) >= k]]


def sentences(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split(b"\n")


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float
    leak: float

    def score(self, text: str, seen: set, marked: dict) -> tuple[float, list[tuple[int, int, float]], int]:
        """The document's score, (start, end, probability) in bytes of its sentences that hold any feature, and the number
        of its sentences. seen and marked keep the words met so far, and the features of those that have any."""
        flat = text.encode("utf-8", "replace").translate(_TABLE)
        parts, words = flat.split(b"\n"), set(flat.split())
        fresh = words - seen
        if fresh:
            if len(seen) > 500_000:
                seen.clear()
            seen |= fresh
            for w in fresh:
                own = tuple(f for f in features_of(w) if f in self.weights)
                if own:
                    marked[w] = own
        hits, found, at = words & marked.keys(), [], 0
        if hits:
            for part in parts:
                own = {f for w in hits.intersection(part.split()) for f in marked[w]}
                if own:
                    found.append((at, at + len(part), 1 / (1 + np.exp(-self.bias - sum(map(self.weights.get, sorted(own)))))))
                at += len(part) + 1
        log = np.log1p(-self.leak) + sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in found)
        return float(-np.expm1(log)), found, sum(map(bool, map(bytes.strip, parts)))


class NoisyOr:
    """The loss of weights, bias and leak (as logits) on bags: (label, lists of features of the sentences that have any)."""

    BIAS = -4.0

    def __init__(self, bags: list[tuple[int, list[list[int]]]], n: int):
        self.y, self.n = np.array([b[0] for b in bags], float), n
        self.doc = np.array([i for i, b in enumerate(bags) for _ in b[1]], int)
        self.row = np.array([j for j, s in enumerate(s for b in bags for s in b[1]) for _ in s], int)
        self.col = np.array([f for b in bags for s in b[1] for f in s], int)

    def loss(self, z: np.ndarray) -> tuple[float, np.ndarray]:
        """(mean log loss with its penalties, gradient)."""
        n, docs = self.n, len(self.y)
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        p, q = sig(z[n] + np.bincount(self.row, z[self.col], len(self.doc))), sig(z[n + 1])
        safe = np.exp(np.log1p(-q) + np.bincount(self.doc, np.log1p(-np.minimum(p, 1 - 1e-9)), docs))
        value = -np.where(self.y > 0, np.log(np.maximum(1 - safe, 1e-12)), np.log(np.maximum(safe, 1e-300))).mean() + 5e-5 * (z[:n] ** 2).sum() + 5e-3 * (z[n] - self.BIAS) ** 2
        pull = np.where(self.y > 0, -safe / np.maximum(1 - safe, 1e-9), 1.0) / docs  # by each sentence's logit, over its p
        each = pull[self.doc] * p
        return float(value), np.concatenate([np.bincount(self.col, each[self.row], n) + 1e-4 * z[:n], [each.sum() + 1e-2 * (z[n] - self.BIAS), pull.sum() * q]])

    def fit(self, rounds: int = 300) -> tuple[np.ndarray, float, float]:
        """Weights, bias and leak by Adam."""
        z = np.concatenate([np.zeros(self.n), [self.BIAS, -4.0]])
        m, v = np.zeros(self.n + 2), np.zeros(self.n + 2)
        for t in range(1, rounds + 1):
            grad = self.loss(z)[1]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            z = z - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        return z[: self.n], float(z[self.n]), float(1 / (1 + np.exp(-z[self.n + 1])))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per feature, the toxic and the harmless documents of a partition that hold it."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"]):
            seen[y > 0].update({f for w in set(text.encode("utf-8", "replace").translate(_TABLE).split()) for f in features_of(w)})
    fs = list(seen[0].keys() | seen[1].keys())
    yield pd.DataFrame({"f": fs, "neg": [seen[0][f] for f in fs], "pos": [seen[1][f] for f in fs]}, columns=["f", "neg", "pos"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on about fit_rows labelled documents that are not held out. Ids labelled twice count as toxic if ever so; an id that
    several rows have gives the model one of its texts. Null ids and labels teach nothing; without both kinds of labels
    every text scores their share."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    sizes = dict(map(tuple, known.groupBy(F.col("y") > 0).count().collect()))
    toxic, harmless = sizes.get(True, 0), sizes.get(False, 0)
    share = min(1.0, fit_rows / max(1, toxic + harmless))
    shares = (share, share)
    if share < 1 and toxic * share < min(LEAST_TOXIC, fit_rows / 2):
        shares = (min(1.0, fit_rows / 2 / max(1, toxic)), min(1.0, fit_rows / 2 / max(1, harmless)))
    below = F.when(F.col("y") > 0, int(shares[0] * (1 << 30))).otherwise(int(shares[1] * (1 << 30)))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < below
    few = F.broadcast(known.where(draw))  # about fit_rows rows, whatever the data
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(few, "id")
    sample = cut(sample.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.crc32("text"))).alias("text"), F.max("y").alias("y")))

    drawn = sample.agg(F.sum((F.col("y") > 0).cast("int")), F.count("*")).first()
    n_pos, n_all = int(drawn[0] or 0), int(drawn[1])
    if not n_pos or n_pos == n_all:
        return Model({}, -20.0, min(max(n_pos / n_all if n_all else 0.0, 1e-4), 1 - 1e-4))
    counted = sample.mapInPandas(_count, "f binary, neg long, pos long").groupBy("f").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p >= 2")
    terms = [F.col("p") + 0.5, n_pos - F.col("p") + 0.5, F.col("n") + 0.5, (n_all - n_pos) - F.col("n") + 0.5]
    odds, spread = F.log(terms[0] / terms[1]) - F.log(terms[2] / terms[3]), F.sqrt(sum(1 / t for t in terms))
    ranked = counted.select("f", odds.alias("odds"), (odds / spread).alias("sure")).where((F.col("odds") > 1) & (F.col("sure") > min(SURE, SURE - 1 + n_pos / 100)))
    index = {bytes(f): i for i, f in enumerate(ranked.orderBy(F.desc("sure"), "f").limit(MAX_FEATURES).toPandas()["f"])}

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, y in zip(pdf["id"], pdf["text"], pdf["y"]):
                held = [sorted({index[f] for w in set(p.split()) for f in features_of(w) if f in index}) for p in sentences(text)]
                out.append((str(i), int(y > 0), [s for s in held if s]))
            yield pd.DataFrame(out, columns=["id", "y", "held"])

    got = sample.mapInPandas(bags, "id string, y int, held array<array<int>>").toPandas().sort_values("id")
    weights, bias, leak = NoisyOr([(y, [list(s) for s in h]) for y, h in zip(got["y"], got["held"])], len(index)).fit()
    shift = np.log(shares[0] / shares[1])  # toxic ones were drawn so much more often: bias and leak go back to all labels
    leak = leak / (leak + (1 - leak) * np.exp(shift))
    return Model({f: float(weights[i]) for f, i in index.items()}, float(bias - shift), float(leak))


RESULT = "score double, n_sentences long, n_offending long, worst_start long, worst_end long, worst_score double, spans array<struct<start:long,end:long,score:double>>"


def _scorer(model: Model, threshold: float):
    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        marked: dict = {}
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                score, found, n = model.score(text, seen, marked)
                raw = text.encode("utf-8", "replace") if found else b""
                chars = lambda k: len(raw[:k].decode("utf-8", "ignore"))  # noqa: B023, E731
                spans = [{"start": chars(a), "end": chars(b), "score": float(p)} for a, b, p in found if p >= threshold]
                worst = max(found, key=lambda s: (s[2], -s[0]), default=None)
                place = (chars(worst[0]), chars(worst[1]), float(worst[2])) if worst else (None, None, None)
                rows.append((min(1.0, max(0.0, score)), n, len(spans), *place, spans))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield out.astype({"worst_start": "Int64", "worst_end": "Int64"})

    return scored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: id, held_out, score, predicted, n_sentences, n_offending, worst_start, worst_end, worst_score, spans.

    spans are the sentences of at least the threshold, by code points. Null and empty texts have no sentence and score
    the leak alone. Only the text feeds the score; rows are scored alone, so ids may be null or repeat.
    """
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), _scorer(model, threshold)(F.col(text_col)).alias("_s"))
    names = [c.split()[0] for c in RESULT.split(", ")]
    return rows.select(id_col, "held_out", "_s.score", (F.col("_s.score") >= threshold).cast("int").alias("predicted"), *[f"_s.{c}" for c in names[1:]])


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each offending sentence: id, start, end (code points), score and its text."""
    kept = docs.select(F.col(id_col), F.col(text_col).alias("_text")).withColumn("_s", F.explode(_scorer(model, 0.5)(F.col("_text"))["spans"]))
    return kept.select(id_col, "_s.start", "_s.end", "_s.score", F.expr("substring(_text, int(_s.start) + 1, int(_s.end - _s.start))").alias("sentence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("spans")

"""Language identification by error-correcting output codes.

Each language owns a codeword of bits. One linear classifier a bit, over hashed byte trigrams, predicts that bit; a
text goes to the codeword with the least weighted logistic loss, and is ambiguous when the runner-up is as near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

BUCKET_BITS = 12
#: The classifiers are fitted on about FIT_ROWS different texts of each language, drawn by a hash of the text, and on fewer of
#: each (but one at least) where that would be over FIT_BUDGET: the bound on what the driver sees. All languages are learned.
FIT_ROWS, FIT_BUDGET = 400, 8192
#: Losses are per bit; a lead below this flags a text as ambiguous.
MARGIN = 0.5
CHUNK = 1 << 22


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Square-rooted, length-one counts of hashed byte trigrams of each whole text, lower-cased, blank-padded."""
    out = np.zeros((len(texts), 1 << BUCKET_BITS), dtype=np.float32)
    raw = [b" " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    at = 0
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) <= CHUNK):
            size, stop = size + len(raw[stop]), stop + 1
        flat = np.frombuffer(b"".join(raw[at:stop]), dtype=np.uint8).astype(np.uint32)
        code = (flat[:-2] << np.uint32(16)) | (flat[1:-1] << np.uint32(8)) | flat[2:]
        code = ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.intp)
        begin = 0
        for i in range(at, stop):
            n = len(raw[i]) - 2
            out[i] = np.bincount(code[begin : begin + n], minlength=1 << BUCKET_BITS)
            begin += n + 2
        at = stop
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1 that differ in many bits: every split of up to 5 languages, else the best random book."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1] + list(bits) for bits in product((1, -1), repeat=n - 1) if -1 in bits], dtype=float).T
    rng, best, width = np.random.default_rng(seed), None, max(15, int(np.ceil(10 * np.log2(n))))
    tries = min(200, 200 * 256**2 // n**2)  # comparing all pairs is quadratic; the width alone keeps many codewords apart
    if not tries:
        return rng.choice([-1.0, 1.0], size=(n, width))
    for _ in range(tries):
        book = rng.choice([-1.0, 1.0], size=(n, width))
        apart = ((width - book @ book.T) / 2)[~np.eye(n, dtype=bool)].min()
        if best is None or apart > best[0]:
            best = (apart, book)
    return best[1]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    book: np.ndarray
    bit_weights: np.ndarray  # (language, bit): how well the bit's classifier serves the language; rows sum to 1
    weights: np.ndarray
    bias: np.ndarray
    margin: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weights + self.bias
        up, down = (np.where(self.book == sign, self.bit_weights, 0.0).T for sign in (1, -1))
        return np.logaddexp(0, -f) @ up + np.logaddexp(0, f) @ down

    def predict(self, texts: list[str], step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score (0 to 1) and ambiguity of each text."""
        best, score, doubt = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a in range(0, len(texts), step):
            loss = self.losses(trigram_counts(texts[a : a + step]))
            own = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
            best[a : a + step], score[a : a + step] = loss.argmin(axis=1), 1 / own.sum(axis=1)
            if loss.shape[1] > 1:
                two = np.partition(loss, 1, axis=1)
                doubt[a : a + step] = two[:, 1] - two[:, 0] < self.margin
        return best, score, doubt


def train(x: np.ndarray, y: np.ndarray, langs: tuple[str, ...], margin: float = MARGIN, rounds: int = 200, l2: float = 1e-5) -> Model:
    """Fit one logistic classifier a bit, all at once, by Adam."""
    book = codebook(len(langs))
    goal = book[y]
    share = 1 / np.bincount(y, minlength=len(langs))[y]  # languages weigh the same
    share /= share.sum()
    w, b = np.zeros((x.shape[1], book.shape[1])), np.zeros(book.shape[1])
    m, v = np.zeros((x.shape[1] + 1, book.shape[1])), np.zeros((x.shape[1] + 1, book.shape[1]))
    x = x.astype(np.float32, copy=False)
    for t in range(1, rounds + 1):
        g = -goal / (1 + np.exp(np.clip(goal * (x @ w.astype(np.float32) + b), -50, 50))) * share[:, None]
        grad = np.vstack([x.T @ g.astype(np.float32) + l2 * w, g.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    right = ((x @ w.astype(np.float32) + b) * goal > 0).astype(float)
    serves = np.array([right[y == k].mean(axis=0) for k in range(len(langs))]) if len(langs) else np.ones_like(book)
    serves = np.maximum(serves, 0.05)
    return Model(langs, book, serves / serves.sum(axis=1, keepdims=True), w.astype(np.float32), b.astype(np.float32), margin)


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, margin: float = MARGIN) -> Model | None:
    """Fit on about fit_rows different texts of each language (fewer if that would be over FIT_BUDGET), from rows with a lang and
    an id that is not held out. Rows are drawn by their text, so it doesn't matter how often ids or texts repeat."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where("lang is not null and id is not null and text is not null").where(~held_out("id"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    counts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.03).alias("n"), F.min(draw).alias("least")).collect()
    if not counts:
        return None
    each = min(fit_rows, FIT_BUDGET / len(counts))
    limits = [(r["lang"], max(int(min(1.0, each / r["n"]) * (1 << 30)), r["least"] + 1) if r["n"] > 0.9 * each else 1 << 30) for r in counts]
    limits = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, below long"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                yield pd.DataFrame({"lang": part["lang"], "x": [r.tobytes() for r in trigram_counts(part["text"].tolist()).astype(np.float16)]})

    drawn = known.join(limits, "lang").where(draw < F.col("below")).select("text", "lang")
    drawn = drawn.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h")
    found = drawn.mapInPandas(features, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    langs = tuple(sorted(found["lang"].unique()))
    if not langs:
        return None
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float16).reshape(len(found), -1).astype(np.float32)
    return train(x, found["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy(), langs, margin)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add lang_pred (``und`` for null texts and those without a letter), score and ambiguous to docs.

    Without a model (nothing to learn from) every text is ``und``. Whole texts are read, in bounded pieces. Columns of docs
    with the names of the results are replaced; all others stay.
    """
    blank = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    if model is None:
        seen = blank
    else:
        langs = np.array(model.langs, dtype=object)

        @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                best, score, doubt = model.predict(texts.fillna("").tolist())
                yield pd.DataFrame({"lang_pred": langs[best], "score": score, "ambiguous": doubt})

        letters = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
        seen = F.when(letters, decode(F.col(text_col))).otherwise(blank)
    names = ("lang_pred", "score", "ambiguous")
    kept, own = [c for c in docs.columns if c not in [prefix + n for n in names]], free("_langid", docs.columns)
    return docs.withColumn(own, seen).select(*kept, *[F.col(f"{own}.{n}").alias(prefix + n) for n in names])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: id, held_out, lang_pred, score, ambiguous. Null ids count as not held out and are never learned from."""
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return predict(rows, model, "_text").drop("_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify(table(spark, sf_dir, "documents"))

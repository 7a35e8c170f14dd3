"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies, target / source size. Its whole part is
taken for certain. The fractional parts are rounded in pairs: words are moved at random between two documents until one
of them holds whole copies, so each document keeps its expectation and the words of the source stay constant. The
documents of a block duel in the order of falling sizes, so that partners are of like size. Only a document too large for
any single partner is paired with all the smaller ones together: each of them gives or takes the same small share, and
none of them turns whole by it. The one document that each block leaves fractional goes up a reduction tree, where the
survivors duel in turn, until a source has one left, which is rounded by chance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, free, identity, numbered, spread, table

#: Documents that one task rounds at once, on average; survivors that one tree node joins at most.
BLOCK, FAN_IN = 2048, 512
EPS = 1e-9
#: A document over LARGE times the size of its next partner is paired with all smaller ones, if that leaves their fraction
#: at least MARGIN (or half of what it was, if that is less) away from 0 and 1.
LARGE, MARGIN = 2.0, 0.05
SPACE_RUN = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_RUN)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Never null; sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _ranked(df: DataFrame, key: str) -> DataFrame:
    """Add rank, gapless from 0 in the order of the unique key, without a window over all rows."""
    parts = cut(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    counts = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "_p int, _o long")
    within = F.expr(f"row_number() over (partition by _p order by {key})")
    return parts.join(F.broadcast(starts), "_p").withColumn("rank", F.col("_o") + within - 1).drop("_p", "_o")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Give each source (unique key, source_size) its weight and target.

    Sources in key order weigh weights, repeating. They share the total by weight; targets stop at cap times the
    source's size and the excess is reshared by weight among the others until none is above. Only totals come to the
    driver. All sizes zero: all targets zero.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = _ranked(sources, "key").withColumn("weight", F.get(w, (F.col("rank") % len(weights)).cast("int"))).drop("rank")
    most = F.lit(cap) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        full = most <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(full, most)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, True)).alias("n")
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], max(level, ((row["total"] or 0) - (row["fixed"] or 0.0)) / row["open"])
    return ranked.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def _duel(a: float, x: float, b: float, y: float, u: float) -> tuple[float, float]:
    """Move words between documents of sizes a, b with fractions x, y until one is whole; u is uniform."""
    up, down = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)
    if u * (up + down) < down:
        return x + up / a, y - up / b
    return x - down / a, y + down / b


def _whole(x: float) -> bool:
    return x < EPS or x > 1 - EPS


def round_block(sizes: np.ndarray, p: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round documents, of falling size, that all hold the fraction p: (fractions, index left fractional or -1)."""
    x, rest, left = np.zeros(len(sizes)), np.cumsum(sizes[::-1])[::-1], -1
    for i, b in enumerate(sizes.tolist()):
        if left < 0:
            x[i], left = p, i if not _whole(p) else -1
            continue
        a, own = float(sizes[left]), x[left]
        if a > LARGE * b:
            low, high = p - (1 - own) * a / rest[i], p + own * a / rest[i]  # the others' fraction if left goes in, or out
            if low > min(MARGIN, p / 2) and high < 1 - min(MARGIN, (1 - p) / 2):
                x[left], p = (1.0, low) if rng.random() < own else (0.0, high)
                x[i], left = p, i
                continue
        x[left], x[i] = _duel(a, own, float(b), p, rng.random())
        if _whole(x[left]):
            x[left], left = round(x[left]), i
        else:
            x[i] = round(x[i])
        if _whole(x[left]):
            x[left], left = round(x[left]), -1
    return x, left


OUT = "key string, block long, id_text string, k1 long, k2 long, copy long, size long, source_size long, target double, base long, x double, open boolean"


def _seed(*parts) -> np.random.Generator:
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest("\x1f".join(map(str, parts))))


def _leaf(seed: int):
    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k1", "k2", "copy"], ascending=[False, True, True, True], ignore_index=True)
        key, block = pdf["key"][0], pdf["block"][0]
        x, left = round_block(pdf["size"].to_numpy(), float(pdf["fraction"][0]), _seed(seed, key, block))
        return pdf.assign(x=x, open=np.arange(len(pdf)) == left)[[c.split()[0] for c in OUT.split(", ")]]

    return leaf


def _node(seed: int, level: int, last: bool):
    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k1", "k2", "copy"], ascending=[False, True, True, True], ignore_index=True)
        rng, size, x = _seed(seed, level, pdf["key"][0], pdf["block"][0]), pdf["size"].to_numpy(float), pdf["x"].to_numpy(float).copy()
        left = -1
        for i in range(len(pdf)):
            if left >= 0:
                x[left], x[i] = _duel(size[left], x[left], size[i], x[i], rng.random())
                if not _whole(x[left]):
                    x[i] = round(x[i])
                    continue
                x[left] = round(x[left])
            left = -1 if _whole(x[i]) else i
            if left < 0:
                x[i] = round(x[i])
        if last and left >= 0:
            x[left], left = float(rng.random() < x[left]), -1
        return pdf.assign(x=x, open=np.arange(len(pdf)) == left)

    return node


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 42,
) -> DataFrame:
    """Per document: id, size (words; null text: 0), source_size, target, taken (words), copies, and its identity k1, k2.

    Documents of size 0 get no copies. A null source is a source of its own, sorted last. Identical rows are told apart
    by number, so repeated rows and null ids are rounded like any other. Empty table: empty result. Reruns agree: all
    randomness is seeded by source and block, and blocks follow from the rows alone.
    """
    source, text = F.col("_source"), F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    one, two = identity(F.col("_id"), source, text)
    rows = rows.select("_id", _source_key(source).alias("key"), n_words(text).alias("size"), one.alias("k1"), two.alias("k2"))
    rows = spread(cut(rows.groupBy("_id", "key", "size", "k1", "k2").agg(F.count("*").alias("n"))), "n", "copy")
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
    facts = cut(targets(sources, weights, cap).withColumn("blocks", blocks))
    total, most = facts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(1))).first()
    copies = F.when(F.col("size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = attach(rows, facts.drop("weight"), ["key"], "n", total).withColumn("exact", copies)
    rows = rows.withColumn("base", F.floor(F.col("exact") + F.lit(EPS)).cast("long")).withColumn("fraction", F.greatest(F.col("exact") - F.col("base"), F.lit(0.0)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("k1", "k2", "copy"), F.col("blocks"))).withColumn("id_text", F.col("_id").cast("string"))
    names = [c.split()[0] for c in OUT.split(", ")]
    certain = rows.where(F.col("fraction") < EPS).withColumn("x", F.lit(0.0)).withColumn("open", F.lit(False)).select(names)
    rounded = cut(rows.where(F.col("fraction") >= EPS).select(*names[:-2], "fraction").groupBy("key", "block").applyInPandas(_leaf(seed), OUT))
    done, level = [certain, rounded.where(~F.col("open"))], 0
    waiting = rounded.where("open")
    while True:
        last, level = most <= FAN_IN, level + 1
        joined = waiting.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long")).groupBy("key", "block").applyInPandas(_node(seed, level, last), OUT)
        if last:
            done.append(joined)
            break
        joined = cut(joined)
        done.append(joined.where(~F.col("open")))
        waiting, most = joined.where("open"), math.ceil(most / FAN_IN)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("base") + F.round("x").cast("long")).alias("copies")
    id_type = docs.schema[id_col].dataType
    return out.select(F.col("id_text").cast(id_type).alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies, "k1", "k2")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of docs, whole, each as often as plan() takes it.

    Rows of equal id, source and text share the copies that plan() gives them; null ids, sources and texts are values of
    their own. Documents of size 0 are not part of a mix; an empty table gives an empty one. Other columns are kept.
    """
    taken, m = plan(docs, id_col, text_col, source_col, **options), free("_mix", docs.columns)
    keys, total, copies = [f"{m}1", f"{m}2"], F.col(f"{m}_sum"), F.col(f"{m}_copies")
    facts = taken.groupBy(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1])).agg(F.sum("copies").alias(f"{m}_sum"), F.count("*").alias(f"{m}_rows"))
    facts = cut(facts.where(total > 0).withColumn(f"{m}_n", F.col(f"{m}_rows")))
    n_rows = facts.agg(F.coalesce(F.sum(f"{m}_n"), F.lit(0))).first()[0]
    one, two = identity(F.col(id_col), F.col(source_col), F.col(text_col))
    joined = attach(docs.select("*", one.alias(keys[0]), two.alias(keys[1])), facts, keys, f"{m}_n", n_rows).where(total.isNotNull())
    joined, uneven = joined.withColumn(f"{m}_copies", F.floor(total / F.col(f"{m}_rows"))), total % F.col(f"{m}_rows") != 0
    if not facts.where(uneven).isEmpty():  # identical rows that get unlike numbers of copies
        odd = numbered(joined.where(uneven), keys, f"{m}_nth")
        odd = odd.withColumn(f"{m}_copies", copies + (F.col(f"{m}_nth") <= total % F.col(f"{m}_rows")).cast("long")).drop(f"{m}_nth")
        joined = joined.where(~uneven).unionByName(odd).where(copies > 0)
    return joined.withColumn(f"{m}_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each of all documents."""
    return plan(table(spark, sf_dir, "documents")).drop("k1", "k2")

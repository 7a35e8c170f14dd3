"""SimHash near-dedup with covering locality-sensitive hashing.

For radius r every fingerprint bit gets a non-zero vector of r + 1 bits, and each non-zero vector v of as many bits
names one table, whose mask keeps the bits with an odd inner product with v. Two fingerprints that differ in at most r
bits differ at bits whose vectors span less than the whole space, so some v is orthogonal to all of them: in that table
they agree on every kept bit. Every pair within the radius therefore collides in some of the 2^(r+1) - 1 tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import attach, cut, free, identity, table

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Buckets with more distinct fingerprints than this are searched by enumerating near fingerprints, not by pairs.
HOT_BUCKET = 64
CHUNK = 1 << 21


def fingerprint(text: str) -> int:
    """SimHash of the 3-word shingles of the text, as an unsigned integer; zero without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: 1 - SHINGLE - 1]]) if len(words) > SHINGLE else np.array([0])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())]
    return _majority(np.array(hashes, dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), CHUNK // BITS):
        part = hashes[a : a + CHUNK // BITS]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprint of each text as a signed 64-bit integer; null counts as the empty text."""
    for texts in batches:
        found = np.array([fingerprint(t or "") for t in texts], dtype=np.uint64)
        yield pd.Series(found.view(np.int64))


def masks(radius: int = RADIUS) -> list[int]:
    """One mask a table. Bit i's vector is 1 + i mod (2^(r+1) - 1), so all vectors are used as evenly as can be."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin((1 + i % n) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(prints: DataFrame, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp, distinct, not null) that differ in at most radius bits.

    Buckets of up to hot members are joined with themselves. In a fuller bucket every fingerprint is instead listed
    under each value that it takes when up to half the radius of its free bits are flipped (and half rounded up on the
    other side): near fingerprints meet at such a value, and no value has more members than that ball holds.
    """
    ms = masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(ms)])
    entries = prints.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    sizes = entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(entries.join(sizes, ["t", "key"]))
    cold = shared.where(F.col("n") <= hot)
    pairs = cold.select("t", "key", F.col("fp").alias("a")).join(cold.select("t", "key", F.col("fp").alias("b")), ["t", "key"]).where("a < b").select("t", "a", "b")
    full = shared.where(F.col("n") > hot)
    if not full.isEmpty():
        lists = F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in ms])
        one = F.concat(F.array(F.lit(0).cast("long")), F.get(lists, F.col("t")))
        flips, others = one, F.array(F.lit(0).cast("long"))
        for k in range(2, radius + 1):
            if k % 2:
                flips = F.array_distinct(F.flatten(F.transform(flips, lambda x: F.transform(one, lambda y: x.bitwiseXOR(y)))))
            else:
                others = flips
        near = lambda name, by: full.select("t", "key", F.col("fp").alias(name), F.explode(by).alias("x")).withColumn("at", F.col(name).bitwiseXOR(F.col("x"))).drop("x")
        met = near("a", flips).join(near("b", others if radius > 1 else F.array(F.lit(0).cast("long"))), ["t", "key", "at"])
        pairs = pairs.unionByName(met.where("a <> b").select("t", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = reduce(lambda rest, tm: F.when(differ.bitwiseAND(F.lit(_signed(tm[1]))) == 0, tm[0]).otherwise(rest), reversed(list(enumerate(ms))), F.lit(-1))
    return pairs.where((F.bit_count(differ) <= radius) & (F.col("t") == first)).select("a", "b")  # each pair once: in its first table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a < b), root the least node of its component, by alternating stars.

    Each turn hangs all neighbours above a node on its least neighbour (large star), then all below (small star), until
    nothing changes; turns grow with the logarithm of the size of a component.
    """
    pairs = cut(edges.select(F.col("a"), F.col("b")))
    before = (pairs.count(),)
    while True:
        n = 2 * before[0]
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")))
        large = cut(attach(both, least, ["a"], "n", n).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct())
        low = cut(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")))
        small = attach(large, low, ["b"], "n", n).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        pairs = cut(small.select("e.a", "e.b").where("a < b").distinct())
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Per distinct fingerprint of rows (id, k1, k2, fp): fp, n rows, near (rows at other fingerprints), root, least row."""
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")  # ids first, null ids last
    prints = cut(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(row).alias("least")))
    pairs = cut(near_pairs(prints.select("fp"), radius))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(prints.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("near"))  # a ball holds few b
    roots = components(pairs).select(F.col("node").alias("fp"), "root")
    known = prints.join(near, "fp", "left").join(roots, "fp", "left")
    return known.withColumn("near", F.coalesce("near", F.lit(0))).withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), n_near, component_id.

    n_near counts the other documents within the radius; component_id is the least id reachable over such links, the
    document's own included (null ids are passed over; null if the component has no other). Copies share one
    fingerprint, so only distinct fingerprints are compared and no pairs of copies are listed. Null texts count as
    empty ones, whose fingerprint is zero. An empty table gives an empty result.
    """
    one, two = identity(F.col(id_col), F.col(text_col))
    rows = cut(docs.select(F.col(id_col).alias("id"), one.alias("k1"), two.alias("k2"), fingerprints(F.col(text_col)).alias("fp")))
    known = cut(_linked(rows, radius))
    ids = cut(known.groupBy("root").agg(F.min("least")["id"].alias("component_id"), F.count("*").alias("_n")))
    facts = cut(attach(known, ids, ["root"], "_n", ids.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]).select("fp", "n", (F.col("near") + F.col("n") - 1).alias("n_near"), "component_id"))
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return attach(rows.drop("k1", "k2"), facts, ["fp"], "n", total).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id"
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of docs, whole, for each component of near copies: the least id (null ids last), once if it repeats.

    Null texts count as empty ones. An empty table gives an empty one; columns keep their names and values.
    """
    one, two = identity(F.col(id_col), F.col(text_col))
    rows = cut(docs.select(F.col(id_col).alias("id"), one.alias("k1"), two.alias("k2"), fingerprints(F.col(text_col)).alias("fp")))
    m = free("_sim", docs.columns)
    keys, many, total = [f"{m}1", f"{m}2"], F.col(f"{m}_many"), rows.count()
    stay = _linked(rows, radius).groupBy("root").agg(F.min("least").alias("r")).select("r.k1", "r.k2")
    stay = rows.groupBy("k1", "k2").agg(F.count("*").alias(f"{m}_n")).join(stay, ["k1", "k2"])
    stay = cut(stay.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), f"{m}_n", (F.col(f"{m}_n") > 1).alias(f"{m}_many")))
    joined = attach(docs.select("*", one.alias(keys[0]), two.alias(keys[1])), stay, keys, f"{m}_n", total).where(many.isNotNull())
    kept = joined.where(~many).select(docs.columns)
    if not stay.where(many).isEmpty():  # rows that repeat whole: combined where they lie before they meet
        first = joined.where(many).groupBy(*keys).agg(F.first(F.struct(*docs.columns)).alias(f"{m}_row")).select(f"{m}_row.*")
        kept = kept.unionByName(first)
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near copies of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))

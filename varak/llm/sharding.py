"""K-d tree sharding: recursive weighted-median splits along the widest metadata dimension.

Rows with equal texts form one group, with one point in metadata space: language, source and (log) size, each scaled
to 24 bits. A node that must yield n shards is cut, along its widest dimension, where its bytes divide as n // 2 to the
rest; ties on the dimension are ordered by a hash of the text, so one heavy language or source can still be cut. All
nodes of a level are cut together. The cut is found by narrowing a histogram that Spark aggregates: the driver sees
bucket totals, never rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, hot_limit, numbered, table

SHARDS, LAW = 24, "bytes"
#: Buckets of one narrowing step; a cut is settled when the bucket that holds it weighs at most TOLERANCE of a shard.
BUCKETS, TOLERANCE = 2048, 0.0005
#: Bucket totals that the driver reads at once, over all nodes of a level.
DRIVER_ROWS = 1 << 17
#: Rows, and bytes of their texts, that one task numbers at once, on average.
SLOT_BLOCK, SLOT_BYTES = 100_000, 2 << 20
DIMENSIONS = ("lang", "source", "size")
_SCALE, _TIE_BITS = 1 << 24, 38


def row_size(text: Column) -> Column:
    """UTF-8 bytes plus 8; null counts as no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _points(groups: DataFrame) -> DataFrame:
    """A 62-bit key per dimension: scaled coordinate, then text hash."""
    named = lambda c: F.when(c.isNull(), F.lit(_SCALE - 1)).otherwise(F.pmod(F.xxhash64(c), F.lit(_SCALE - 1)))
    least, most = groups.agg(F.min("size"), F.max("size")).first()
    span = max(1e-9, np.log2(most or 8) - np.log2(least or 8))
    size = F.floor((F.log2("size") - F.lit(float(np.log2(least or 8)))) / F.lit(float(span)) * (_SCALE - 1))
    tie = F.shiftrightunsigned(F.xxhash64("h1", "h2", "part"), 64 - _TIE_BITS)
    coordinates = dict(zip(DIMENSIONS, (named(F.col("lang")), named(F.col("source")), size)))
    return groups.withColumns({f"k_{d}": F.shiftleft(c.cast("long"), _TIE_BITS).bitwiseOR(tie) for d, c in coordinates.items()})


def _key(d: Column) -> Column:
    """The key of the dimension with this number."""
    return reduce(lambda rest, i: F.when(d == i, F.col(f"k_{DIMENSIONS[i]}")).otherwise(rest), range(1, len(DIMENSIONS)), F.col(f"k_{DIMENSIONS[0]}"))


def _cuts(points: DataFrame, wanted: dict[int, tuple[int, int, int, float]], tolerance: float) -> dict[int, tuple[int, float]]:
    """Per node, given its dimension, least and most key and the bytes that should lie left: (cut, bytes it is off by).

    Keys below the cut go left. points has node and the keys. Each step aggregates some buckets a node and keeps the
    bucket in which the wanted weight falls. Nodes share DRIVER_ROWS buckets, and more nodes than DRIVER_ROWS / 16 take turns,
    so many nodes take more steps, not more memory; what is broadcast has one row a node.
    """
    found: dict[int, tuple[int, float]] = {}
    nodes, at_once = list(wanted.items()), max(1, DRIVER_ROWS // 16)
    for begin in range(0, len(nodes), at_once):
        found |= _narrow(points, dict(nodes[begin : begin + at_once]), tolerance)
    return found


def _narrow(points: DataFrame, state: dict[int, tuple[int, int, int, float]], tolerance: float) -> dict[int, tuple[int, float]]:
    """_cuts() for at most DRIVER_ROWS / 16 nodes."""
    found: dict[int, tuple[int, float]] = {}
    while state:
        buckets = max(2, min(BUCKETS, DRIVER_ROWS // len(state)))
        spans = [(n, d, lo, hi, max(1, -(-(hi - lo + 1) // buckets))) for n, (d, lo, hi, _) in state.items()]
        spans = F.broadcast(points.sparkSession.createDataFrame(spans, "node int, d int, lo long, hi long, w long"))
        rows = points.join(spans, "node").withColumn("v", _key(F.col("d"))).where("v between lo and hi")
        totals = rows.groupBy("node", F.expr("(v - lo) div w").alias("b")).agg(F.sum("bytes").alias("bytes"), F.min("v").alias("least"), F.max("v").alias("most"))
        following = {}
        for n, own in totals.toPandas().sort_values(["node", "b"]).groupby("node"):
            d, _, _, want = state[n]
            upto = np.cumsum(own["bytes"].to_numpy(float))
            at = min(int(np.searchsorted(upto, want)), len(own) - 1)
            before = upto[at - 1] if at else 0.0
            least, most = int(own["least"].iloc[at]), int(own["most"].iloc[at])
            if upto[at] - before <= tolerance or least == most:
                under, over = want - before, upto[at] - want
                found[n] = (least, under) if under < over else (most + 1, over)
            else:
                following[n] = (d, least, most, want - before)
        state = following
    return found


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Give every group (h1, h2, part, bytes, size, lang, source) its shard by the k-d tree.

    Where a heavy group keeps the widest dimension from dividing the bytes within 1 % of a shard, the next dimensions
    are tried and the best cut is taken. Of the data the driver reads at most DRIVER_ROWS bucket totals at a time; besides it
    holds the tree, which is a few numbers a shard.
    """
    spark = groups.sparkSession
    points, depth = cut(_points(groups).withColumn("node", F.lit(0))), 0
    leaves = {0: (0, shards)}  # node: first shard, number of shards
    while any(k > 1 for _, k in leaves.values()):
        ends = [f(f"k_{d}").alias(f"{a}_{d}") for d in DIMENSIONS for a, f in (("least", F.min), ("most", F.max))]
        stats = points.groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends).toPandas().set_index("node").to_dict("index")
        unit = sum(float(r["bytes"]) for r in stats.values()) / shards
        breadth = lambda r, d: (r[f"most_{d}"] >> _TIE_BITS) - (r[f"least_{d}"] >> _TIE_BITS)
        order = {n: sorted(range(len(DIMENSIONS)), key=lambda i: -breadth(stats[n], DIMENSIONS[i])) for n, (_, k) in leaves.items() if k > 1 and n in stats}
        best: dict[int, tuple[float, int, int]] = {}
        for turn in range(len(DIMENSIONS)):
            due = {n: ds[turn] for n, ds in order.items() if n not in best or best[n][0] > 0.01 * unit}
            wanted = {n: (i, stats[n][f"least_{DIMENSIONS[i]}"], stats[n][f"most_{DIMENSIONS[i]}"], float(stats[n]["bytes"]) * (leaves[n][1] // 2) / leaves[n][1]) for n, i in due.items()}
            for n, (at, off) in _cuts(points, wanted, TOLERANCE * unit).items():
                best[n] = min(best.get(n, (off, wanted[n][0], at)), (off, wanted[n][0], at), key=lambda x: x[0])
        fresh, following, moves = max(leaves) + 1, {}, []
        for n, (first, k) in leaves.items():
            if n in best:
                moves.append((n, best[n][1], best[n][2], fresh))
                following[fresh], following[fresh + 1] = (first, k // 2), (first + k // 2, k - k // 2)
                fresh += 2
            else:
                following[n] = (first, 1)
        if moves:
            splits = F.broadcast(spark.createDataFrame(moves, "node int, d int, at long, left int"))
            moved = F.when(F.col("d").isNull(), F.col("node")).otherwise(F.col("left") + (_key(F.col("d")) >= F.col("at")).cast("int"))
            points = points.join(splits, "node", "left").withColumn("node", moved).drop("d", "at", "left")
            depth += 1
            points = cut(points) if depth % 4 == 0 else points
        leaves = following
    firsts = F.broadcast(spark.createDataFrame([(n, first) for n, (first, _) in leaves.items()], "node int, shard int"))
    return points.join(firsts, "node")


def shard(
    docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None,
) -> DataFrame:
    """Shard all documents by bytes: the carried columns (default: the id), size, text_crc32, law, shard, slot, grown_shard.

    Give shards, or target_bytes for as many as bring a leaf to that size. Sums of size are near equal. Equal texts
    share a shard, except a text whose copies outweigh half a shard: those are spread by id, and rows of one id by number,
    over 64 parts that are weighed one by one. Null texts count as empty ones (size 8, crc 0); null languages and sources
    are values of their own. Ids may be null or repeat: each row gets its own slot, gapless from 0 within its shard. Fewer
    texts than shards leave shards empty; an empty table gives an empty result. grown_shard is null under this law.
    """
    carry = [id_col] if carry is None else carry
    text, mine = F.coalesce(F.col(text_col), F.lit("")), [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(
        *[F.col(c).alias(m) for c, m in zip(carry, mine)], F.xxhash64(F.col(id_col)).alias("hid"), row_size(F.col(text_col)).alias("size"), F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("h2"), text).alias("h2"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
    )
    if text_col not in carry:
        rows = cut(rows)
    facts = (F.sum("size").cast("double").alias("bytes"), F.max("size").alias("size"), F.count("*").alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    groups = cut(rows.groupBy("h1", "h2").agg(*facts))
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = int(max(1, -(-total // target_bytes))) if target_bytes else shards
    giant = (F.col("bytes") > F.lit(total / shards / 2)) & (F.col("n") > 1)  # at most 2 * shards groups
    known, special = groups.withColumn("part", F.lit(0)), giant | (F.col("n") > hot_limit(count))
    flags = groups.where(special).select("h1", "h2", giant.alias("giant"))
    rows, plain = rows.drop("lang", "source"), [F.lit(0).cast("long").alias("nth"), F.lit(0).alias("part")]
    if flags.isEmpty():
        rows = rows.select("*", *plain)
    else:
        marked = rows.join(F.broadcast(flags), ["h1", "h2"], "left")
        apart = numbered(marked.where(F.col("giant").isNotNull()), ["h1", "h2", "hid"], "nth")  # equal rows of a heavy text
        apart = cut(apart.withColumn("part", F.when(F.col("giant"), F.pmod(F.xxhash64("hid", "nth"), F.lit(64))).otherwise(0).cast("int")))
        weighed = apart.where("giant").groupBy("h1", "h2", "part").agg(F.sum("size").cast("double").alias("b"), F.count("*").alias("k"))
        heavy = weighed.join(F.broadcast(groups.where(giant)), ["h1", "h2"]).select("h1", "h2", F.col("b").alias("bytes"), "size", F.col("k").alias("n"), "lang", "source", "part")
        known = known.where(~giant).unionByName(heavy)
        rows = marked.where(F.col("giant").isNull()).select(*rows.columns, *plain).unionByName(apart.select(*rows.columns, "nth", "part"))
    placed = cut(shard_groups(cut(known), shards).select("h1", "h2", "part", "n", "shard"))
    rows = attach(rows, placed, ["h1", "h2", "part"], "n", count)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("hid", "h1", "nth"), F.lit(int(1 + max(count / SLOT_BLOCK, total / SLOT_BYTES) // shards))))
    counts = rows.groupBy("shard", "block").count().withColumn("start", F.expr("sum(count) over (partition by shard order by block) - count")).drop("count")
    rows = rows.join(counts, ["shard", "block"])
    nth = F.expr("row_number() over (partition by shard, block order by hid, h1, nth)")
    return rows.withColumn("slot", (F.col("start") + nth - 1).cast("long")).select(
        *[F.col(m).alias(c) for c, m in zip(carry, mine)], "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all documents."""
    return shard(table(spark, sf_dir, "documents"))

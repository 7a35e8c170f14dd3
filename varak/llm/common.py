"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varak.sources.files import shared_dir
from varak.sources.files import spread as spread_input

#: At most this many keys are broadcast as hot ones: those with over total / HOT_KEYS rows, and over HOT_ROWS.
HOT_KEYS, HOT_ROWS = 1 << 17, 1000
#: Rows that one task lists for one group of repeated rows at a time.
SPREAD = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_input(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Tables that cut() wrote and release() hasn't removed yet.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/varak-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for release()."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: list[DataFrame] = ()) -> None:
    """Remove the tables that cut() has written since mark(), but for those that the frames in keep are read from.

    For the end of a step whose result is written: no other frame that was made in it can be run again.
    """
    used = {part for f in keep for name in f.inputFiles() for part in name.split("/")}
    for path in _written[since:]:
        if path.rsplit("/", 1)[1] not in used:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _written.remove(path)


def let(value: Column, body) -> Column:
    """Bind value once inside a projection: body sees a lambda variable, not a repeated expression."""
    return F.transform(F.array(value), body)[0]


def free(prefix: str, columns: list[str]) -> str:
    """The prefix, made longer until no column begins with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def identity(*columns: Column) -> tuple[Column, Column]:
    """128 bits that tell rows apart by these columns; nulls count as values of their own, equal rows are equal here."""
    nulls = F.concat(*[c.isNull().cast("string") for c in columns])
    return F.xxhash64(*columns, nulls), F.xxhash64(nulls, *reversed(columns))


def hot_limit(total: int) -> int:
    """Keys with more rows than this are hot. There are at most HOT_KEYS of them, whatever the data."""
    return max(HOT_ROWS, total // HOT_KEYS)


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Left-join to rows the facts of their keys, safe for hot keys.

    facts has one row per key and counts the key's rows in column n. Hot keys, at most HOT_KEYS, are broadcast and their
    rows stay where they are; the others are joined by shuffle, where a key holds at most HOT_ROWS rows or one part in
    HOT_KEYS of all, and adaptive execution splits what is still large. Keys must not be null. The count column isn't
    returned.
    """
    limit = hot_limit(total)
    extra = [c for c in facts.columns if c not in keys and c != n]
    if facts.where(F.col(n) > limit).isEmpty():
        return rows.join(facts.drop(n), keys, "left").select(*rows.columns, *extra)
    hot = facts.where(F.col(n) > limit).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in extra], F.lit(True).alias("_hot"))
    cold = facts.where(F.col(n) <= limit).drop(n)
    marked = rows.join(F.broadcast(hot), keys, "left")
    done = marked.where(F.col("_hot")).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in extra])
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns).join(cold, keys, "left").select(*rows.columns, *extra)
    return done.unionByName(rest)


def spread(rows: DataFrame, n: str, nth: str) -> DataFrame:
    """Repeat each row n times, numbered from 1 in column nth; a large n is spread over tasks, not listed by one. rows should
    be a written table, as it is read twice."""
    if (rows.agg(F.max(n)).first()[0] or 0) <= SPREAD:
        return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(nth)).drop(n)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / SPREAD)))
    rows, first = rows.withColumn("_part", part).repartition("_part", *rows.columns), F.col("_part") * SPREAD
    return rows.select("*", F.explode(F.sequence(first + 1, F.least(first + SPREAD, F.col(n)))).alias(nth)).drop(n, "_part")


def numbered(rows: DataFrame, keys: list[str], nth: str) -> DataFrame:
    """Number rows of equal keys from 1, without bringing them together.

    The rows are written once with the part they lie in, numbered within each part, and the parts of a key are counted
    up. Meant for rows whose keys repeat; others need no number.
    """
    laid = cut(rows.withColumn("_p", F.spark_partition_id()))
    starts = laid.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    own = ", ".join(keys)
    starts = starts.select(*keys, "_p", F.expr(f"sum(_n) over (partition by {own} order by _p) - _n").alias("_o"))
    within = laid.withColumn("_w", F.expr(f"row_number() over (partition by {own}, _p order by _p)"))
    return within.join(starts, [*keys, "_p"]).withColumn(nth, F.col("_o") + F.col("_w")).select(*rows.columns, nth)

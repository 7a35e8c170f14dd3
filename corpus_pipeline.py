"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varak.llm import decontamination, langid, mixing, sharding, simhash
from varak.llm.common import cut, mark, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (no letter, or null) and those whose language is ambiguous.

    Rows are judged alone: repeated rows and null ids stay or go by their texts. Without a known language in docs nothing can be
    learned and every document goes; an empty table stays empty.
    """
    model = langid.fit(docs)
    judged = langid.predict(docs, model, prefix="_langid_")
    return judged.where((F.col("_langid_lang_pred") != "und") & ~F.col("_langid_ambiguous")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the least id (null ids last; of equal rows any one).

    Documents without words are near copies of each other. An empty table stays empty.
    """
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, whole, edited or in large part.

    Null and empty texts are clean; rows are judged alone, so ids may be null or repeat. Without items all stay.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix of sources wants it; rows repeat.

    A null source is a source of its own; documents without words are left out, as no mix of words can hold them. Equal rows
    share what the mix takes of them. An empty table stays empty.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row into a shard: the columns of documents, then size, text_crc32, law, shard, slot and grown_shard.

    Repeated rows and null ids get slots of their own; equal texts share a shard unless they outweigh half of one. An empty
    table stays empty.
    """
    return sharding.shard(docs, carry=docs.columns)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: Trained classifiers, seeded hashing and random rounding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharded mix of all documents. What a stage writes on the way is removed when its result is written."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark, since, keep=[docs])
    return docs

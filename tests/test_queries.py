import os

import pytest

import __spark_entry__ as entry_module
from tests.compare import same
from varak.operators import pairs
from varak.plans import core_queries
from varak.sources import files

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(core_queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(core_queries.queries()[name](spark, SMALL), core_queries.oracle_sql()[name], SMALL)


def test_all_have_sql():
    assert set(core_queries.queries()) == set(core_queries.oracle_sql())


@needs_data
def test_entry(spark):
    found = entry_module.entry(spark)
    assert found.count() == 18  # of the 200 small documents
    assert found.columns == ["doc_id", "pair_idx", "original", "translation", "similarity", "pair_type"]


def test_registry():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert "poetic_pairs" in queries and "corpus_totals" in sql
    assert all(isinstance(s, str) for s in sql.values())


@needs_data
def test_pairs_are_one_narrow_stage(spark):
    found = pairs.mine_pairs(spark.read.parquet(f"{SMALL}/documents.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@needs_data
def test_small_tables_are_spread_and_others_left_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert files.spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert files.spread(docs.repartition(9)).rdd.getNumPartitions() == 9
    plan = files.spread(docs).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan

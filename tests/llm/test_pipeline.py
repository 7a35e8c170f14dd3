from collections import Counter

import pytest

import corpus_pipeline as C
from tests.llm.conftest import SMALL, needs_data
from tests.llm.test_duplicates import links
from varak.llm import common, decontamination, langid


@needs_data
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, stages = docs.columns, dict(C.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]

    kept = common.cut(stages["language_id"](spark, docs, SMALL))
    judged = langid.predict(docs, langid.fit(docs), prefix="p_")
    assert kept.columns == names and kept.count() == judged.where("p_lang_pred <> 'und' and not p_ambiguous").count() >= 0.99 * docs.count()

    single = common.cut(stages["near_dedup"](spark, kept, SMALL))
    want = {c for _, _, _, c in links([(r.doc_id, r.text) for r in kept.collect()])}
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == sorted(want)

    clean = common.cut(stages["decontamination"](spark, single, SMALL))
    bad = decontamination.contaminated(single, spark.read.parquet(f"{SMALL}/benchmark.parquet")).select("doc_id").distinct()
    assert clean.columns == names and clean.count() == single.count() - bad.count() and bad.count() > 0

    mixed = common.cut(stages["mixing"](spark, clean, SMALL))
    assert mixed.columns == names and max(Counter(r.doc_id for r in mixed.collect()).values()) in (2, 3)

    out = stages["sharding"](spark, mixed, SMALL)
    assert out.columns[: len(names)] == names and out.count() == mixed.count()
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mixed.collect())


def test_cut_and_release(spark, docs):
    since = common.mark()
    a, b = (common.cut(docs([(i, "x")])) for i in (1, 2))
    common.release(spark, since, keep=[b])
    assert b.first().doc_id == 2 and common.mark() == since + 1
    with pytest.raises(Exception, match="(?i)not exist|no such file|not found"):
        a.first()


def test_numbers_of_equal_rows(spark, docs, monkeypatch):
    rows = docs([(i % 3, "same") for i in range(50)] + [(None, "n")] * 7).repartition(5).select("text", "doc_id")
    got = common.numbered(rows.select("text", "doc_id"), ["text", "doc_id"], "nth").collect()
    assert Counter((r.doc_id, r.nth) for r in got if r.doc_id is not None) == Counter((i, n) for i, k in ((0, 17), (1, 17), (2, 16)) for n in range(1, k + 1))
    table = common.cut(spark.createDataFrame([("a", 1), ("b", 7), ("c", 3)], "k string, n long"))
    for size in (100, 2):
        monkeypatch.setattr(common, "SPREAD", size)
        assert sorted(tuple(r) for r in common.spread(table, "n", "i").collect()) == [(k, i) for k, n in (("a", 1), ("b", 7), ("c", 3)) for i in range(1, n + 1)]


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://a:7077"))
    for master in ("spark://a:7077", "local-cluster[3,2,1024]", "yarn"):
        bare.sparkContext.master = master
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            common.shared_dir(bare)


@needs_data
def test_run_is_the_stages_in_a_row(spark):
    a, b = (sorted((r.doc_id, r.shard, r.slot) for r in C.run(spark, SMALL).collect()) for _ in range(2))
    assert a == b and len(a) > 100


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "12 34"), (1, None)], [(i, "Ein Text mit Wörtern.", "de", None) for i in (3, 3, None, 7)]])
def test_edge_tables_pass_all_stages(spark, docs, rows, tmp_path):
    spark.createDataFrame([(1, "an item of some words that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs(rows)
    for _, stage in C.STAGES:
        df = common.cut(stage(spark, df, str(tmp_path)))
    assert df.count() <= len(rows)

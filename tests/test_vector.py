"""The functions over batches equal plain Python, and each sentence is looked at once."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_text import SIGNS, fuzz
from varak.functions import sql as Q
from varak.functions import text as T
from varak.functions import vector as V
from varak.operators import lexicon as L
from varak.operators import sentences as S
from varak.operators import stats as A
from varak.sources import files as X

SCHEMA = "doc_id long, line_idx long, sent_idx long, sentence string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_signs_of_batches(monkeypatch, chunk):
    monkeypatch.setattr(V, "CHUNK", chunk)
    rng = random.Random(3)
    texts = fuzz() + ["".join(rng.choices("ab1 _\n", k=rng.randint(1, 40))) for _ in range(3000)]
    texts += ["x" + ("abcdefghij" * n)[:k] + " " + "abcdefghij" * m for n in (1, 2, 3, 4) for k in (19, 20, 30, 39, 40) for m in (0, 1, 2)]
    got = V.signs(texts)
    for name, sign in SIGNS.items():
        assert got[name].tolist() == [bool(sign(t)) for t in texts], name
    assert got["needs_correction"].tolist() == [any(s(t) for s in SIGNS.values()) for t in texts]
    assert V.signs([])["needs_correction"].tolist() == [] and V.signs(["ab " * 50_000])["short_words"].tolist() == [True]


def test_one_look_repairs_a_sentence(spark):
    """the regular expressions ran in the filter and the projections anew."""
    rows = spark.createDataFrame([(1, 0, 0, "3.14 a?"), (1, 0, 1, "1037 e"), (1, 0, 2, None), (1, 0, 3, "iyi"), (1, 0, 4, "")], SCHEMA)
    fixed = S.repair(rows, lambda texts: [None if "?" in t else t.replace("e", "i") for t in texts])
    got = [(r.corrected, r.cleanliness, r.was_corrected) for r in fixed.orderBy("sent_idx").collect()]
    assert got == [("3.14 a?", 0.0, False), ("1037 i", 5 / 6, True), (None, 1.0, False), ("iyi", 1.0, False), ("", 1.0, False)]
    for df in (fixed, fixed.where("was_corrected").select("corrected", "cleanliness")):
        assert plan(df).count("ArrowEvalPython") == 1 and "RLIKE" not in plan(df)


def test_records_are_one_look_and_one_format(spark):
    """records keep corrected sentences only, by a filter that must not judge them once more."""
    df = X.repair_records(S.repair(spark.createDataFrame([(1, 0, 0, "3.14"), (1, 0, 1, "iyi")], SCHEMA)))
    assert [r.value for r in df.collect()] == ["Original: 3.14\nCorrected: 3. 14\nCleanliness: 0.40\n"]
    assert plan(df).count("ArrowEvalPython") == 2 and "RLIKE" not in plan(df)


def test_report_counts(spark):
    """both sides are counted in batches, as plain Python counts them."""
    assert V.report_counts("a\x1cb. c?! . ") == (4, 11, 4, 3)
    assert V.report_counts("") == (0, 0, 0, 0)
    df = A.repair_report(S.repair(spark.createDataFrame([(1, 0, 0, "3.14 a."), (1, 0, 1, None)], SCHEMA)))
    assert "regexp_count" not in plan(df) and "split" not in plan(df)
    row = df.first()
    assert (row.original_tokens, row.corrected_characters, row.original_sentences, row.corrected_words_per_sentence) == (2, 8, 2, 1.5)


def test_flags_are_one_look(spark):
    """eleven expressions ran once for their column and once for needs_correction."""
    rows = [(1, 0, i, t) for i, t in enumerate(["la la la la", "haha haha ha", None, "iyi", ""])]
    df = S.flag_sentences(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") + [*V.REPAIR_SIGNS, "needs_correction"]
    got = [(r.repeated_chunk, r.short_words, r.needs_correction) for r in df.orderBy("sent_idx").collect()]
    assert got == [(False, True, True), (True, False, True), (None, None, None), (False, False, False), (False, False, False)]
    kept = df.where("needs_correction")
    assert plan(kept).count("ArrowEvalPython") == 1 and "RLIKE" not in plan(kept)


def test_letters_are_told_by_a_nested_class(spark):
    """a flat negated class was asked all the way down for each character. Both agree on all code points."""
    texts = [("".join(chr(i) + "a" for i in range(a, a + 0x1000) if not 0xD800 <= i < 0xE000),) for a in range(0, 0x110000, 0x1000)]
    df = spark.createDataFrame([*texts, ("",), (None,), ("  İI ıi-É_9 ",)], "t string")
    flat = F.regexp_replace("t", f"[^{T.LETTERS}]", "\x01")
    assert df.where(~F.regexp_replace("t", T.NOT_LETTER, "\x01").eqNullSafe(flat)).count() == 0
    Q.register(spark)
    df.createOrReplaceTempView("letter_rows")
    used = spark.sql("SELECT varak_clean_text(t) c, varak_word_set(t) w FROM letter_rows")
    for p in (plan(used), plan(df.select(T.clean_text(F.col("t")), T.word_set(F.col("t"))))):
        assert f"[^{T.LETTERS}]" not in p and "lambda" not in p
    assert [tuple(r) for r in used.collect()][-3:] == [("", []), (None, None), ("i̇i ıi", ["i̇i", "ıi"])]


def test_words_meet_the_lists_where_they_lie(spark):
    """all distinct words of all texts were shuffled to the lists; only counts are now."""
    df = spark.createDataFrame([(1, "Para ve para, akçe. Devlet"), (1, "para"), (None, "cami"), (2, None), (3, "x")], "doc_id long, text string")
    counts, rest = L.marker_counts(df, L.starter(spark), "semantics"), L.without_stopwords(df, L.starter(spark))
    for p in (plan(counts), plan(rest)):
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "hashpartitioning(marker#" not in p.split("BroadcastExchange")[0]
    assert sorted(map(tuple, counts.collect()), key=repr) == [(1, "economic", 3), (1, "political", 1), (None, "religious", 1)]
    assert sorted(map(tuple, rest.collect()), key=repr) == [(1, 4), (3, 1), (None, 1)]


def test_texts_are_corrected_by_the_same_look(spark):
    """corrected_text shares the step."""
    df = S.correct_texts(spark.createDataFrame([(1, "3.14\n\niyi. la la la la"), (2, None), (3, "")], "doc_id long, text string"))
    assert plan(df).count("ArrowEvalPython") == 1 and "rlike" not in plan(df).lower()
    assert [tuple(r) for r in df.collect()] == [(1, "3. 14 \n \niyi. la la la la \n"), (2, None), (3, " \n")]

import json

import pytest
from pyspark.sql import functions as F

from varak.config import Config, load_config
from varak.operators import lexicon as L
from varak.operators import pairs as P
from varak.operators import sentences as S
from varak.operators import stats as A


def mined(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.original, r.translation, r.similarity, r.pair_type) for r in P.mine_pairs(df, **kw).orderBy("pair_idx").collect()]


def test_direct_pairs(spark):
    text = "This is original text.\n\n_This is translated version here._\n\nAnother original.\n\n_Another translation._"
    assert mined(spark, text)[-1] == ("Another original.", "Another translation.", 1 / 3, "direct_pair")


@pytest.mark.parametrize(
    "text, n",
    [
        ("a b c\na b d", 1),
        ("a b c\na b d\n\nx", 0),
        ("a b c\na b d\n\n", 0),
        ("a b c\na b d\ne f", 1),  # an odd last line is left out
        ("a b c\n\x0b\na b d\ne f", 0),  # a blank line shifts the couplets
        ("a b\n\n_", 0),
        ("", 0),
        (None, 0),
        ("a b c", 0),
    ],
)
def test_pairs_of_edge_texts(spark, text, n):
    assert len(mined(spark, text)) == n


def test_translation_may_be_the_next_original(spark):
    got = mined(spark, "a b c\n\n_a b c_\n\n_a b c_")
    assert [g[:2] for g in got] == [("a b c", "a b c"), ("_a b c_", "a b c")]


def test_poetic_threshold_is_fixed_and_verification_is_not(spark):
    text = "a b c d e\na b f g h"  # 2 of 8
    assert mined(spark, text, min_similarity=0.9) == [("a b c d e", "a b f g h", 0.25, "poetic")]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert P.verify_pairs(P.mine_pairs(df)).count() == 0


def test_all_paragraphs_is_an_extension(spark):
    assert len(mined(spark, "a b c\na b d\n\nx y\nx y", all_paragraphs=True)) == 2


def test_sentences(spark):
    df = spark.createDataFrame([(1, "Bir. İki! üç?  \n\nson")], "doc_id long, text string")
    got = [(r.line_idx, r.sent_idx, r.sentence) for r in S.sentences(df).orderBy("line_idx", "sent_idx").collect()]
    assert got == [(0, 0, "Bir."), (0, 1, "İki!"), (0, 2, "üç?"), (1, 0, ""), (2, 0, "son")]


def test_repair_calls_the_corrector_for_flagged_sentences_only(spark):
    df = spark.createDataFrame([(1, 0, 0, "iyi"), (1, 0, 1, "1037 sene"), (1, 0, 2, "bad 1234")], "doc_id long, line_idx long, sent_idx long, sentence string")

    def corrector(batch):
        assert "iyi" not in batch
        if "bad 1234" in batch:
            raise RuntimeError("one of them can't be done")
        return [s.replace("1037", "1038") for s in batch]

    got = {r.sentence: (r.corrected, r.cleanliness, r.was_corrected) for r in S.repair(df, corrector).collect()}
    assert got == {"iyi": ("iyi", 1.0, False), "1037 sene": ("1038 sene", 8 / 9, True), "bad 1234": ("bad 1234", 0.0, False)}


def test_texts_are_rebuilt_in_their_own_rows(spark):
    rows = [(1, "First row 1037. And two."), (1, "Second row x. And y.\n\nKötü  3.14! Son"), (None, ""), (2, None), (3, "\x1c. a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in S.correct_texts(df).collect()]
    assert got[0] == (1, "First row 1037. And two. \n") and got[2:] == [(None, " \n"), (2, None), (3, ". a \n")]
    assert got[1] == (1, "Second row x. And y. \n \nKötü  3.14! Son \n") or got[1] == (1, "Second row x. And y. \n \nKötü 3. 14! Son \n")
    assert "Exchange" not in S.correct_texts(df)._jdf.queryExecution().executedPlan().toString()

    def corrector(batch):
        return [None if "3.14" in t else t.replace("1037", "1038") for t in batch]

    fixed = [(r.doc_id, r.text) for r in S.correct_texts(df, corrector).collect()]
    assert fixed[0] == (1, "First row 1038. And two. \n") and fixed[1] == (1, "Second row x. And y. \n \nKötü  3.14! Son \n") and fixed[2:] == got[2:]


def test_a_corrector_of_the_wrong_length_is_asked_one_by_one(spark):
    df = spark.createDataFrame([(1, 0, 0, "1037 bir"), (1, 0, 1, "1038 iki")], "doc_id long, line_idx long, sent_idx long, sentence string")
    got = S.repair(df, lambda batch: [batch[0].upper()]).collect()
    assert sorted(r.corrected for r in got) == ["1037 BIR", "1038 IKI"]


def test_report_text(spark):
    df = spark.createDataFrame([(1, 0, 0, "3.14 a."), (1, 0, 1, "iyi")], "doc_id long, line_idx long, sent_idx long, sentence string")
    text = A.report_text(A.repair_report(S.repair(df))).first()["value"].split("\n")
    assert text[2:5] == ["Tokens: 2 before, 3 after, -1 fewer", "Characters: 7 before, 8 after, -1 fewer", "Sentences: 2 before, 2 after, 0 fewer"]
    assert A.report_text(A.repair_report(S.repair(df.limit(0)))).first()["value"].endswith("Cleanliness: - on average, - to -")


def test_report_over_nothing_has_null_averages(spark):
    df = S.repair(spark.createDataFrame([], "doc_id long, line_idx long, sent_idx long, sentence string"))
    row = A.repair_report(df).first()
    assert row.original_tokens == 0 and row.avg_cleanliness is None and row.original_words_per_sentence is None


def test_totals_and_injected_tokens(spark):
    df = spark.createDataFrame([(1, "Ab. Cd!"), (2, None)], "doc_id long, text string")
    stats = A.text_stats(df, counter=lambda texts: [len(t.split()) for t in texts])
    assert A.totals(stats).first().asDict() == {"tokens": 2, "sentences": 2, "words": 2, "characters": 7, "files_processed": 2}
    assert A.text_stats(df).where("tokens is not null").count() == 0


def test_lexicon(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"sub": ["a", "a", "b"]}))
    (tmp_path / "mixed.json").write_text(json.dumps({"x": ["c"], "y": {"z": ["d"]}}))
    (tmp_path / "broken.json").write_text("{")
    lex = L.load_lexicon(spark, tmp_path)
    assert sorted(map(tuple, lex.collect())) == [("flat", "flat", "sub", "a"), ("flat", "flat", "sub", "b"), ("mixed", "mixed", "x", "c"), ("mixed", "y", "z", "d")]
    assert L.load_lexicon(spark, tmp_path / "missing.json").count() == 0
    more = L.add_markers(lex, "flat", "sub", ["b", "é"])
    assert sorted(r.marker for r in L.get_markers(more, "flat", "sub").collect()) == ["a", "b", "é"]
    assert L.get_markers(lex, "none", "sub").count() == 0
    L.save_lexicon(more, tmp_path / "out")
    assert "\\u00e9" in (tmp_path / "out" / "flat.json").read_text()
    assert L.load_lexicon(spark, tmp_path / "out").count() == 5
    assert L.is_valid(L.starter(spark)) and not L.is_valid(lex)


def test_marker_in_two_lists_counts_in_both(spark):
    lex = spark.createDataFrame([("s", "c", "x", "ve"), ("s", "c", "y", "ve")], L.SCHEMA)
    df = spark.createDataFrame([(1, "Ve ve bir")], "doc_id long, text string")
    assert sorted((r.subcategory, r.n_markers) for r in L.marker_counts(df, lex, "c").collect()) == [("x", 1), ("y", 1)]
    assert L.stopwords(L.starter(spark)).where(F.col("marker").isin("ve", "ile")).count() == 2


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"pdf_extraction": {"dpi": 72}}))
    before = file.read_text()
    got = load_config(file)
    assert got.pdf_extraction.dpi == 72 and got.pdf_extraction.margins == (50, 50, 0, 0) and file.read_text() == before
    assert load_config(tmp_path / "none.json") == Config()
    file.write_text(json.dumps({"nonsense": 1}))
    with pytest.raises(ValueError, match="nonsense"):
        load_config(file)

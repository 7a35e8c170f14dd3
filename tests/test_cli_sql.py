import pytest
from pyspark.sql import functions as F

from varak import cli
from varak.functions import sql as Q
from varak.functions import text as T
from varak.sources.files import CORPUS_FILE


def fake(content, options):
    return content.decode()


def test_commands(spark, tmp_path):
    src = tmp_path / "in"
    (src / "a").mkdir(parents=True)
    (src / "a" / CORPUS_FILE).write_text("Bir iki. üç")
    (src / "t.txt").write_text("a b c\na b d\n\narz ve ya")
    (src / "x.pdf").write_bytes(b"%PDF-x")

    def go(*words):
        args = cli.parser().parse_args(["-i", str(src), "-o", str(tmp_path / words[0]), *words])
        cli.run(spark, args)
        return spark.read.parquet(str(tmp_path / words[0]) + ("/total" if words[0] == "stats" else ""))

    assert go("pairs").count() == 0
    assert go("stats").first().words == 3
    assert sorted((r.subcategory, r.n_markers) for r in go("analysis", "--type", "formality").collect()) == [("formal_markers", 1), ("informal_markers", 1)]
    with pytest.raises(ValueError, match="syntax"):
        go("analysis", "--type", "syntax")
    assert go("extract", "--converter", "tests.test_cli_sql:fake", "--workers", "2").first().text == "%PDF-x"


@pytest.mark.parametrize(
    "words, hint",
    [
        (["-i", "{0}", "-o", "x", "analysis", "--type", "formalty"], "formality"),
        (["-i", "{0}", "-o", "x", "pears"], "pairs"),
        (["-i", "{0}/inputt", "-o", "x", "pairs"], "did you mean input?"),
    ],
)
def test_mistypes_are_named(tmp_path, capsys, words, hint):
    (tmp_path / "input").mkdir()
    with pytest.raises(SystemExit):
        cli.parser().parse_args([w.format(tmp_path) for w in words])
    assert hint in capsys.readouterr().err
    assert sorted(p.name for p in tmp_path.iterdir()) == ["input"]


def test_sql_functions_equal_the_columns(spark):
    Q.register(spark)
    rows = [("Bu, bir test. Ve kâr!", "bir 1037 test"), (" \xa0a b\x1c", ""), (None, "x"), ("3.14 'q'", "la la la la ")]
    df = spark.createDataFrame(rows, "a string, b string")
    df.createOrReplaceTempView("sql_rows")
    got = spark.sql(
        "SELECT varak_strip_space(a) s, varak_word_count(a) w, varak_sentence_count(a) n, varak_clean_text(a) c, "
        "varak_set_similarity(varak_word_set(a), varak_word_set(b)) j, varak_needs_correction(b) f FROM sql_rows"
    )
    a, b = F.col("a"), F.col("b")
    want = df.select(T.strip(a), T.word_count(a), T.sentence_count(a), T.clean_text(a), T.similarity_of_sets(T.word_set(a), T.word_set(b)), T.needs_correction(b))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()

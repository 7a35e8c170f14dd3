import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tests.llm.conftest import SMALL, needs_data
from varak.llm import quality_rules as Q
from varak.llm import url_filter as U


@needs_data
def test_quality_equals_sql(spark):
    same(Q.query(spark, SMALL), Q.SQL, SMALL)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_of_edge_texts(spark, docs):
    random.seed(3)
    texts = [None, "", " \t\n", "a", "a b c d e f g h " * 3, "x\n\nx\n x\n", "a b #|<\x1c y", " ".join(random.choice("ab") for _ in range(60)), "w " * 7, "é\U0001f600 " * 9]
    rows = {r.doc_id: r for r in Q.quality(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_keeps_prose_and_drops_junk(docs):
    prose = "It was the best of times and it was the worst of times for all of us who had to live in it, as we were told then by men with hats."
    junk = " ".join(f"&&{i}||" for i in range(40))
    assert [r.kept for r in Q.quality(docs([(1, prose), (2, junk)])).orderBy("doc_id").collect()] == [True, False]


def test_quality_of_a_very_long_text(docs):
    text = " ".join(f"word{i % 5000}" for i in range(300_000))
    r = Q.quality(docs([(1, text), (1, text), (None, text)])).collect()
    assert len(r) == 3 and {x.n_repeat_words for x in r} == {300_000}


def test_quality_is_one_narrow_stage_and_ignores_other_columns(docs):
    df = docs([(1, "a b")]).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("_m", F.lit(0))
    out = Q.quality(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and out.first().n_words == 2
    assert Q.quality(docs([])).count() == 0


@needs_data
def test_urls_equal_sql(spark):
    same(U.query(spark, SMALL), U.SQL, SMALL)


def test_automaton_equals_fnmatch():
    random.seed(5)
    for _ in range(60):
        globs = tuple("".join(random.choice("ab*?é") for _ in range(random.randint(0, 9))) for _ in range(random.randint(1, 40)))
        texts = ["".join(random.choice("abcé\U0001f600") for _ in range(random.randint(0, 12))) for _ in range(40)]
        want = [any(re.fullmatch(fnmatch.translate(g), t, re.S) for g in globs) for t in texts]
        assert U.ShiftAnd(globs).matches(texts).tolist() == want
    assert U.ShiftAnd(()).matches(["a"]).tolist() == [False] and U.ShiftAnd(("*a*",)).matches([]).tolist() == []


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://x.net/fr/", "x.net", "/fr/", "net/", "block"),
        ("https://x.net", "x.net", "", None, "allow"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("https://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"),
        ("http://b.org/fr/?q", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://casino-win.example.com/en", "casino-win.example.com", "/en", None, "block"),
        ("http://a.com/go?u=http://free-bets.com/", "a.com", "/go", None, "block"),
        ("http://a.com/Casino/", "a.com", "/Casino/", None, "block"),
        ("http://SPAM-farm.example.com/a", "spam-farm.example.com", "/a", None, "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://h/p", "h", "/p", None, "allow"),
        ("http://É.com/\nx", "É.com", "/\nx", None, "allow"),
        ("http://" + "a" * 70_000 + ".net/" + "b" * 70_000, "a" * 70_000 + ".net", "/" + "b" * 70_000, "net/", "block"),
    ],
)
def test_verdicts(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(None, url, "x", "y")], "page_id long, url string, host string, verdict string")
    assert tuple(U.url_verdicts(df).first()) == (None, host, path, rule, verdict)
    assert U.url_verdicts(df.limit(0)).count() == 0

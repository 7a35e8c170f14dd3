import pytest

from varak.operators.stats import text_stats, totals
from varak.sources import files as X
from varak.streaming import streams


@pytest.fixture
def corpus(tmp_path):
    for name, text in (("a", "Bir.\r\nİki! "), ("b c+d", "üç")):
        (tmp_path / name).mkdir()
        (tmp_path / name / X.CORPUS_FILE).write_bytes(text.encode())
    (tmp_path / "empty").mkdir()
    return tmp_path


def test_corpus(spark, corpus):
    rows = X.read_corpus(spark, str(corpus))
    assert {r.folder: r.text for r in rows.collect()} == {"a": "Bir.\nİki! ", "b c+d": "üç"}
    assert X.folders_without_corpus(spark, str(corpus)) == ["empty"]
    stats = text_stats(rows, "folder")
    total = totals(stats)
    assert (total.first().files_processed, total.first().characters) == (2, 12)
    assert "Sentence count: 2" in [r.value for r in X.folder_info(stats).collect() if r.folder == "a"][0]
    assert X.total_info(total).first().value.split("\n")[2] == "Files processed: 2"


def _pdfs(tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.4 text")
    (tmp_path / "bad.pdf").write_bytes(b"plain")
    (tmp_path / "fails.pdf").write_bytes(b"%PDF-boom")
    return [str(tmp_path / f) for f in ("good.pdf", "bad.pdf", "fails.pdf")]


def _convert(content, options):
    if b"boom" in content:
        raise RuntimeError("boom")
    return content.decode() + f" at {options.dpi}"


def test_pdfs(spark, tmp_path):
    paths = _pdfs(tmp_path)
    got = {r.path.rsplit("/", 1)[1]: r for r in X.read_pdfs(spark, [*paths, paths[0]], _convert).collect()}
    assert got["good.pdf"].text == "%PDF-1.4 text at 300" and got["good.pdf"].error is None
    assert got["bad.pdf"].error.error_type == "ValueError" and got["fails.pdf"].error.message == "boom"
    assert X.read_pdfs(spark, paths, _convert, on_error="drop").count() == 1
    with pytest.raises(Exception, match="boom"):
        X.read_pdfs(spark, [paths[2]], _convert, on_error="fail").collect()
    with pytest.raises(FileNotFoundError):
        X.read_pdfs(spark, [str(tmp_path / "none.pdf")], _convert)
    with pytest.raises(ValueError, match="regular"):
        X.read_pdfs(spark, [str(tmp_path)], _convert)


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 0.0625, "poetic")], "original string, translation string, similarity double, pair_type string")
    assert X.pair_report(pairs).first().value.split("\n") == ["Original: a", "Translation: b", "Similarity: 0.062", "Type: poetic", "-" * 80]
    X.write_text("x", tmp_path / "deep" / "t.txt")
    assert (tmp_path / "deep" / "t.txt").read_text() == "x"
    texts = spark.createDataFrame([("/p/a.pdf", "one"), ("/q/a.pdf", "two"), ("/r", None)], "path string, text string")
    X.write_markdown(texts, str(tmp_path / "md"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "md")).collect()) == ["one", "two"]
    fixed = spark.createDataFrame([("o", "c", 0.125, True), ("p", "p", 1.0, False)], "sentence string, corrected string, cleanliness double, was_corrected boolean")
    assert [r.value for r in X.repair_records(fixed).collect()] == ["Original: o\nCorrected: c\nCleanliness: 0.12\n"]


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("a b c\na b d")
    texts = streams.stream_texts(spark, str(src))
    streams.drain(streams.stream_pairs(texts), str(tmp_path / "pairs"), str(tmp_path / "cp1"))
    streams.drain(streams.stream_stats(streams.stream_texts(spark, str(src))), str(tmp_path / "stats"), str(tmp_path / "cp2"))
    (src / "2.txt").write_text("x y\nx y")
    streams.drain(streams.stream_pairs(streams.stream_texts(spark, str(src))), str(tmp_path / "pairs"), str(tmp_path / "cp1"))
    assert sorted(r.similarity for r in spark.read.parquet(str(tmp_path / "pairs")).collect()) == [0.5, 1.0]
    assert spark.read.parquet(str(tmp_path / "stats")).first().words == 6
    (tmp_path / "pdf").mkdir()
    _pdfs(tmp_path / "pdf")
    streams.drain(streams.stream_pdfs(spark, str(tmp_path / "pdf"), _convert), str(tmp_path / "md"), str(tmp_path / "cp3"))
    assert sorted(r.text or "" for r in spark.read.parquet(str(tmp_path / "md")).collect()) == ["", "", "%PDF-1.4 text at 300"]


def test_default_converter(monkeypatch):
    import sys
    from contextlib import nullcontext
    from types import SimpleNamespace

    monkeypatch.setitem(sys.modules, "pymupdf", None)
    with pytest.raises(RuntimeError, match="converter"):
        X.library_converter(b"%PDF-", X.ExtractionOptions())
    monkeypatch.setitem(sys.modules, "pymupdf", SimpleNamespace(open=lambda stream, filetype: nullcontext((filetype, stream))))
    monkeypatch.setitem(sys.modules, "pymupdf4llm", SimpleNamespace(to_markdown=lambda pdf, **told: (pdf, told["dpi"])))
    assert X.library_converter(b"%PDF-", X.ExtractionOptions(dpi=9)) == (("pdf", b"%PDF-"), 9)

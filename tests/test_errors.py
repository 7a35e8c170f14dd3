import logging

import pytest

from varak.errors import ExtractionFailed, errors_of, logged, raise_first
from varak.sources.files import extract_pdfs


def test_failures_have_a_side_table(spark):
    rows = spark.createDataFrame([("a", b"%PDF-ok"), ("b", b"no")], "path string, content binary")
    done = extract_pdfs(rows, lambda content, options: "text")
    assert [(r.file_path, r.error_type, r.details) for r in errors_of(done).collect()] == [("b", "ValueError", None)]
    with pytest.raises(ExtractionFailed, match="ValueError in b"):
        raise_first(done)
    raise_first(done.where("path = 'a'"))


def test_logged(caplog):
    @logged
    def fails(x):
        """Doc."""
        raise KeyError(x)

    with caplog.at_level(logging.ERROR), pytest.raises(KeyError):
        fails(1)
    assert "fails failed" in caplog.text and fails.__doc__ == "Doc."

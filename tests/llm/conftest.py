import os

import pytest

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) or (id, text, lang, source) tuples."""

    def make(rows):
        return spark.createDataFrame([(*r, *((None, None)[len(r) - 2 :] if len(r) < 4 else ()), None) for r in rows], DOCS)

    return make

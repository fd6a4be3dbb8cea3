import pytest


@pytest.fixture
def docs(spark):
    """Makes documents (doc_id, text, lang, source, n_chars) from (doc_id, text) rows."""

    def make(rows, lang="en"):
        full = [(i, t, lang, "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make

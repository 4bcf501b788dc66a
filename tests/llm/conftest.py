import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as documents, with more columns whose names operators also use."""

    def make(rows, source="src0"):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in ((*r, source)[:3] for r in rows)]
        return spark.createDataFrame(full, DOCS).selectExpr("*", "1 AS size", "2 AS key", "'x' AS hash", "3 AS fp", "4 AS row")

    return make

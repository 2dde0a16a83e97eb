import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark):
    """Documents from ``(doc_id, text[, lang, source])`` tuples, with a clashing extra column."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""))
                for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        return df.selectExpr("*", "doc_id AS fp", "'x' AS kept") if extra else df
    return make

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows -> a documents table with columns that clash with names the operators use."""

    def make(rows, columns=DOCS):
        df = spark.createDataFrame([tuple(r) for r in rows], columns)
        return df.selectExpr("*", "1 AS score", "'x' AS row", "2 AS size", "3 AS length", "4 AS _fp", "5 AS _source", "'k' AS key", "6 AS spans", "7 AS _k1")

    return make

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents (doc_id, text, and columns whose names results use too) from pairs."""

    def build(rows):
        rows = [(i, t, "x", 7, [1.0]) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, n_tokens int, score array<double>")

    return build

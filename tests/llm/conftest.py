import pytest


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) with the other columns, nulls among them, and clashing extra ones."""

    def make(rows):
        full = [(d, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", len(t or ""), i, "x") for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, length long, component_id string")

    return make

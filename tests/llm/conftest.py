import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from texts, with further columns whose names clash with those of results."""

    def make(*texts, **columns):
        rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make

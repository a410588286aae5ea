import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], TEXT).repartition(3)

    return make

import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang); extra columns clash with names used inside."""

    def make(rows, partitions=3):
        rows = [(*r, "en")[:3] for r in rows]
        full = [(i, t, lang, "src", len(t or ""), 1, "x", 7) for i, t, lang in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, class long, doc string, k1 long"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make

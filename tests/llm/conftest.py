import pytest


#: Columns of documents, with an extra one whose name clashes with what operators add.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, name string, node long"


@pytest.fixture
def documents(spark):
    def build(*rows):
        """(doc_id, text[, lang]) rows."""
        full = [(i, t, (*rest, "en")[0], "s", len(t) if t else 0, 0.5, "x", 1) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return build

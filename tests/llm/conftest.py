import pytest


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        full = [(*r, *("en", "s", len(r[1] or ""))[len(r) - 2 :]) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, schema)

    return make

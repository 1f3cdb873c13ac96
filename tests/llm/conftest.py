import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, schema)

    return make

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(rows, **extra):
        df = spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows], SCHEMA)
        return df

    return make

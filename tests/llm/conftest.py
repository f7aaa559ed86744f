import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """``docs([(id, text), ...])`` -> a table with the columns of documents."""
    def build(rows, columns=SCHEMA):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, columns)
    return build


@pytest.fixture(scope="session")
def by_id():
    def run(df, key="doc_id"):
        return {r[key]: r for r in df.collect()}
    return run

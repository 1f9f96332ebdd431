import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs; with a clashing column besides."""

    def make(*items, extra=True):
        pairs = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(items)]
        rows = [(i, t, "xx", "src", None if t is None else len(t), "clash") for i, t in pairs]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
        return df if extra else df.drop("score")

    return make

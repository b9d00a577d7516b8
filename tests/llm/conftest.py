import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with a column that operators don't know; ids from 0 unless given as pairs."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([Row(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, very long, repeated and tied rows, a null id."""
    long = " ".join(f"w{k % 977}a{k % 31}" for k in range(60_000))
    return [(0, None), (1, ""), (2, " \n\t "), (3, long), (4, long), (5, "a b c"), (5, "a b c"), (6, "A b C"), (None, "one two three four five six"),
            (7, "one two three four five six"), (8, "one two three four five six seven"), (9, "é ñ 中文 text\r\nline")]

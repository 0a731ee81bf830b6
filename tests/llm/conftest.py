import pytest
from pyspark.sql import types as T

from tablelens.llm.common import importable

#: Texts that every operator has to bear: null, empty, blank, tiny, repeated, very long, odd characters.
ODD = [None, "", " ", "\n\n", "a", "a", "x" * 50_000, "word " * 20_000, "é𝄞  b\x00c", "# head\n\nline one.\nline one."]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    importable(spark)


@pytest.fixture
def documents(spark):
    """Make documents of (doc_id, text, source), with extra columns whose names clash with inner ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, fp long, place string, _says int, kept int"

    def make(rows, source="s"):
        full = [(i, t, "en", source, 0, 1, 2, "p", 3, 4) for i, t in rows]
        return spark.createDataFrame(full, T._parse_datatype_string(schema))

    return make


@pytest.fixture
def odd(documents):
    rows = list(enumerate(ODD)) + [(None, "no id"), (None, None), (5, "a")]
    return documents(rows)

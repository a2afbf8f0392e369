import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import pytest

#: Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own.
LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
COPY = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while under the old tree by the river where nobody ever goes at night because it is dark"
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    COPY,
    COPY,
    COPY.upper(),
    COPY + " again",
    "A line here.\nA line here.\nAnother line, with words in it. And the end!",
    "mail me at jane.doe@example.com or +1 (212) 555-0123 from 10.0.0.1, card 4111111111111111.",
    "ÉCOLE des Beaux-Arts — 日本語 text with ﬁ ligature \U0001f600 and é",
    LONG,
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, w string, t string, spans string, key string, n int, node long, `at` string, ids string"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z", "k", 1, 2, "p", "q") for i, t in enumerate(TEXTS)]
    rows += [(5, COPY, "en", "s", len(COPY), "x", "y", "z", "k", 1, 2, "p", "q"), (None, COPY, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def written_docs(spark, tmp_path):
    """Writes texts (doc_id: their number) as documents.parquet with an empty benchmark beside it; returns the folder."""

    def write(texts):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write

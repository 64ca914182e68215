import pytest

#: Columns besides those of documents, with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, kept string, spans string, quality string, target string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 1, "r", "k", "x", "q", "t") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, repeated ids."""
    long = " ".join(f"w{i % 977} übung" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, long), (7, "same words here again and again"), (8, "same words here again and again"), (8, "same words here again and again"), (None, "no id at all"), (9, "first text of nine"), (9, "second text of nine"), (10, "日本語 text «é»", None)]

import pytest


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """A Parquet table from rows, as the operators get it."""

    def make(rows, schema):
        path = str(tmp_path_factory.mktemp("t") / "rows.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make


DOCS = "doc_id bigint, text string, n_words string, row string, hi string"
LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
SHARED = " ".join(f"shared{i}" for i in range(70))


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, LONG, "a", "b", "c"),
        (2, LONG, None, "b", "c"),
        (2, LONG, None, "b", "c"),
        (3, None, "a", None, "c"),
        (4, "", "a", "b", None),
        (None, LONG + " tail", "a", "b", "c"),
        (None, None, None, None, None),
        (5, f"Start here. {SHARED} and one end", "a", "b", "c"),
        (6, f"Other start {SHARED}\nsecond line", "a", "b", "c"),
        (7, " \t\n\u000b ", "a", "b", "c"),
        (8, "two words", "a", "b", "c"),
        (9, "TWO\twords", "a", "b", "c"),
        (10, "é ü ñ 漢字 \U0001f600 " * 30, "a", "b", "c"),
        (11, "solo", "a", "b", "c"),
        (12, f"{LONG}\n{SHARED} {SHARED}", "a", "b", "c"),
        (13, "x" * 3000, "a", "b", "c"),
        (14, "y" + "x" * 200, "a", "b", "c"),
    ]
    return rows, DOCS

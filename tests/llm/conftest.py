import pytest


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


#: null and empty texts, ties, repeated rows, null ids, exotic spaces, one long text, clashing extra columns
ODD = [
    (1, None), (2, ""), (3, "one"), (4, "a b c d"), (5, "A B C D"), (5, "a b c d"), (6, " \t\n\x0b\x0c\r "),
    (7, " ".join(f"w{i % 500}" for i in range(60_000))), (8, "x" * 50_000), (None, "a null id here"), (9, "é 中文 🎉 <|endoftext|> ▁ a b"),
    (10, "the same line here again and again for more than twenty words\n" * 8), (11, "the same line here again and again for more than twenty words\n" * 8),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "a", 1, b"k", 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n int, key binary, rank double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")

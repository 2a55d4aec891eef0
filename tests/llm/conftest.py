import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, shard int, node long, k long, n long, s long, hit int, text_key string, terms array<int>, sid int, part int, start long, root long, digest string"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 1, 2, 3, 4, 5, 6, 7, 8, "x", [1], 9, 10, 11, 12, "y")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators may use themselves."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        row(1, "the quick brown fox jumps over the lazy dog"), row(2, "the quick brown fox jumps over the lazy dog", source=None),
        row(3, None), row(4, ""), row(5, "   \n\t "), row(6, long_text, lang=None), row(7, "Émile naïve — “quotes” 日本語 😀"),
        row(8, "one two"), row(8, "one two"), row(None, "one two three", source=None), row(None, None), row(9, "x" * 30_000),
        row(10, "12345 !!! ???"), row(11, "ONE TWO"), row(12, "a b c d e f g", source="b"),
    ]
    return spark.createDataFrame(rows, COLUMNS).persist()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)

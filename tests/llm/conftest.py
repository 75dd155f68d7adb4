import pytest

LONG = "the quick brown fox jumps over the lazy dog. " * 4000 + "x" * 50_000


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows and odd characters, with columns whose names clash."""
    texts = [
        None, "", "   \n\t ", "a", "One two. three", "ÀÉÎ ß ñ 日本 𓀀 \u0000     é", LONG, "same text here for all of us", "same text here for all of us",
        "mail bob@example.com or +1 (555) 123-4567 or 10.0.0.300 and 4111 1111 1111 1111!", "<s> <0x0A> </s> <|endoftext|> ▁x", "don't stop, it's 12,345.67",
    ]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), "extra", 1, [1]) for i, t in enumerate(texts)]
    rows += [rows[7], (None, "same text here for all of us", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, row int, items array<int>"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def medium():
    return "/root/testdata/sf0.01"

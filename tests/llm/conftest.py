import pytest

LONG = ("Lorem ipsum dolor sit amet consectetur " * 6000).strip()
TEXTS = [
    (1, "The quick brown fox, it jumps! Over the lazy dog's 12 <|endoftext|> bone"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "The quick brown fox, it jumps! Over the lazy dog's 12 <|endoftext|> bone"),
    (5, "The quick brown fox, it jumps! Over the lazy dog's 12 <|endoftext|> bone"),
    (5, "another text under the same number, with é, ß, Σ and \u3000wide\xa0space 漢字 😀"),
    (None, "a text without a number"),
    (9, LONG),
    (10, "x" * 3000),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", None, 5, "mine", 1, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, columns string, n_tokens long, kept long").cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def prose(spark):
    """The smallest documents and what goes with them."""
    return {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages")}

import pytest

LONG = " ".join(f"w{i % 977} of the long text" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "   \n \t\n", "en", "a", 0),
    (4, "one two three four five six seven eight nine ten", "en", None, 0),
    (4, "one two three four five six seven eight nine ten", "en", None, 0),
    (5, "one two three four five six seven eight nine ten", "en", "b", 0),
    (None, "one two three four five six seven eight nine eleven", None, None, None),
    (None, None, None, None, None),
    (4, "another text under the same id as before, and it is long enough to count as words go", "de", "b", 1),
    (6, LONG, "en", "a", 0),
    (7, "ünïcödé 漢字 🙂 ▁ token<|endoftext|>  double   triple    \n\n x \n", "fr", "b", 2),
    (8, "hi", "fr", "b", 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, repeated and missing ids, and extra columns that clash with inner names."""
    rows = [(*r, 7, "x", "y", 1.5) for r in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, th long, row string, gone string, n_words double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd, spark):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

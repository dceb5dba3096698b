import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c long, label string, __n string, size string, taken string, site string"
SENTENCE = "the quick brown fox jumps over the lazy dog while seven small birds sing about rain and wind in the old oak tree by the river"


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names an operator might use."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", SENTENCE, SENTENCE, SENTENCE.upper(), SENTENCE + " today", long, "é" * 50, "# * $\n# * $\n# * $", "a\nb\na\nb\n", "x " * 400]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], (None, SENTENCE, None, None, None), (None, None, None, None, None), (20, "only " + SENTENCE, None, None, 3)]
    return [(*r, 1, "l", "n", "z", "t", None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

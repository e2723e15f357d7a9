import pytest

LONG = "a line that is long enough to count as a repeated line of forty"

#: Nulls, empty and white texts, ties, repeated rows, upper case, other scripts and a very long text.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today"),
    (2, "the QUICK brown fox jumps over the lazy dog again and again today"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, f"{LONG}\nx\n{LONG}"),
    (7, f"  {LONG.upper()}\t\ny"),
    (8, f"{LONG}"),
    (9, f"z\n{LONG}\n"),
    (10, f"{LONG}\nlast"),
    (11, "Été à Noël, ça va? Größe ÄÖÜ ñandú 日本語 🙂 don't we'll <|endoftext|> x"),
    (12, "word " * 30_000),
    (13, "one two three"),
    (13, "one two three"),
    (None, "one two three"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """ROWS with columns whose names clash with those that operators add or use inside."""
    rows = [(i, t, None, "k", 7, "h") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept boolean, k string, n long, h string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")

import pytest

DOCS = "doc_id long, text string, lang string, source string, size int, row string, name string, n long, key int, word string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that trip things up: nulls everywhere, blanks, copies, a long text, clashing names."""
    plain = "one two three four five six seven eight nine ten eleven twelve"
    other = (7, "r", "n", 3, 1, "w")
    rows = [
        (1, plain, "en", "a", *other[:1], *other[1:]),
        (1, plain, "en", "a", 7, "r", "n", 3, 1, "w"),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", None, 0, "", "", 0, 0, ""),
        (4, " \t\r\n\x0b\x0c ", "de", "b", 0, "", "", 0, 0, ""),
        (5, " ".join(f"w{i % 997}" for i in range(60_000)), "en", "a", 0, "", "", 0, 0, ""),
        (None, plain, "en", "a", 0, "", "", 0, 0, ""),
        (6, plain.upper(), "fr", "c", 0, "", "", 0, 0, ""),
        (7, "\u00c9t\u00e9 \U0001f600 \x1c x", "fr", "c", 0, "", "", 0, 0, ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, `_digest` string, score string, size string, "
    "label string, `_time` string, rep string, `_lost` string, `a.b` string"
)
CLASHES = ("x",) * 8

LONG = " ".join(f"w{i % 997}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, very long and equal texts, repeated rows and columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1),
        (2, "ALPHA beta gamma delta epsilon zeta", "en", "a", 1),
        (2, "ALPHA beta gamma delta epsilon zeta", "en", "a", 1),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \t\n", "fr", None, 3),
        (6, LONG, "en", "b", 1),
        (7, LONG + " tail", "en", "b", 1),
        (None, "no id here", None, None, None),
        (None, None, None, None, None),
        (8, "one", "fr", "c", 3),
        (9, "Été ünïcode \U0001f600 x", "fr", "c", 3),
        (10, "a" * 100_000, "en", "c", 3),
    ]
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)

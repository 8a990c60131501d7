import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, root long, KEPT_ID string, mix_id int, version string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, ties, repeated rows, empty and long texts, and columns named like internal ones."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), None, None), (4, None, "en", "b"), (5, "", "de", None),
        (6, " \n\t ", "en", "b"), (7, long, "en", "c"), (8, long + " end", "en", "a"), (None, "no id here at all", "en", "c"), (None, None, None, None),
        (9, "single", "en", "é"), (10, "mail me at ann@mail.example.org or +49 (0)30 1234567", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 99, "s", 0, "k", 5, "v") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

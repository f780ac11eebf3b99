import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and of to with in on by an as or it is was for this that not be from".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "er", "tion", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    a, b = prose(60, 1), prose(60, 2)
    rows = [
        (1, a, "en", "s0"), (2, a, "en", "s0"), (3, a + " end", "fr", "s1"), (3, a + " end", "fr", "s1"), (4, b, None, None),
        (5, None, "en", "s0"), (6, "", "de", "s2"), (7, "   \n\t ", "de", "s2"), (8, "12345 6789 !!", "en", "s0"), (None, b, "en", "s1"),
        (None, None, None, None), (9, prose(60_000, 3), "en", "s0"), (10, "x", "fr", None), (11, "Éêé  two  spaces\r\n <|endoftext|> 中文 🙂", "fr", "s1"),
        (12, "one two", "en", "s2"), (13, "A\x0bB\x1cC", "en", "s2"), (-20, prose(500, 5), "en", "s0"), (100, prose(200, 6), "en", "s0"),
    ]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["fp", "root", "component_id", "rank", "key", "block", "bucket", "task", "row", "length", "score", "y", "x", "v", "epoch", "count", "_key", "host", "path", "rule"]
    return odd.select("*", *[F.lit("extra").alias(n) for n in names])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def write_tables(folder, **frames):
    """Tables as the queries read them."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)

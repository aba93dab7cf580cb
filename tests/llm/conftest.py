import pytest

#: id, text, and columns whose names could clash with an operator's own.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from the small village near the river today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from the small village near the river today.", "en", "a"),
    (3, "THE quick brown fox jumps over the lazy dog and runs far away from the small village near the river today", "en", None),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \t\n", "de", "b"),
    (7, "word", "en", "b"),
    (8, "12 34 !!", "fr", "b"),
    (9, "lang " * 30_000, "en", "b"),
    (10, "z" * 50_000, "en", "b"),
    (11, "Ｆｕｌｌ  width ﬁne\u00a0text Straße 日本語 😀😀", "de", "c"),
    (12, "a\n\nb\r\nc   d\u2028e <|endoftext|> it's", "es", "c"),
    (None, "no id at all here", "en", "c"),
    (13, "repeated row", "en", "c"),
    (13, "repeated row", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("score", "n", "rule", "kept", "word", "key", "component_id", "range", "salt", "group", "host")}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (7, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"

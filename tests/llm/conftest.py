import pytest

SF = "/root/testdata/sf0.001"

LONG = "alpha beta gamma delta " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty, blank and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [(1, "One two three four five six.", "en", "a", 28), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, " \n\t ", "en", "a", 4), (5, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)),
            (6, "One two three four five six.", "en", "a", 28), (7, "ünïcode çé ß 🙂 " * 30, "de", "b", 480),
            (8, "x" * 5000, "fr", "c", 5000), (9, "1234 5678 --- !!!", "es", "c", 17), (None, "a row without an id", "en", "d", 19)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *[f"'{c}' AS {c}" for c in
                                ("fingerprint", "score", "slot", "key", "bytes", "shard", "row", "h", "n", "pos", "item_id")])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

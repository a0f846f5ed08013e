import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""
    base = " ".join(f"word{i % 97}x{i % 89}" for i in range(400))
    long = "tail " + " ".join(f"w{i * i % 1009}" for i in range(60_000))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 2), (3, base + " more", "fr", None, 3),
        (4, None, "en", "b", 4), (5, "", None, "b", 5), (6, "   \n\t ", "de", None, 6), (7, "12 34 !!", "de", "c", 7),
        (8, "one two", "en", "c", 8), (9, "one two", None, "c", None), (10, long, "en", "a", 10), (11, long, "en", "a", 11),
        (12, "été à la mer, où êtes-vous?", "fr", "d", 12), (12, "été à la mer, où êtes-vous?", "fr", "d", 12),
        (None, base, "en", "a", 13), (None, None, None, None, None), (14, "x" * 5000, "en", "", 14), (15, "x" * 5000, "en", "", 15),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    # Names that operators make themselves.
    return df.withColumns({c: F.lit("old") for c in ("size", "taken", "shard", "slot", "target", "license_id", "score", "kept", "digest", "key", "weight", "n")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

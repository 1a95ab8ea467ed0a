import pytest


@pytest.fixture(scope="session")
def sf(spark):
    """The smallest generated tables."""
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    prose = " ".join(words[i * 7 % 15] + str(i % 11) for i in range(300))
    rows = [
        (1, prose, "en"), (1, prose, "en"), (2, prose + " end", "en"), (3, None, None), (4, "", "en"), (5, " \n\t ", "de"), (None, "lone text without an id", "en"),
        (6, "x" * 70_000, "en"), (7, "word " * 5_000, "fr"), (8, "é😀 ünï\x00codé\x1c 中文", "es"), (9, "token=abcdef123456 " * 3, "en"),
    ]
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("score", "kept", "found", "class_id", "Threshold", "n_bytes", "id", "node")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]
from given import CLASH, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty, blank and very long texts, copies, ties and a repeated row."""
    plain = " ".join(f"word{i % 97} and{i % 89}" for i in range(200))
    rows = [
        (1, plain, "en", "a", 1),
        (2, plain, "en", "b", 1),
        (2, plain, "en", "b", 1),
        (3, plain + " tail", "en", None, None),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, " \n\t ", "de", "c", 3),
        (7, "one two", "de", "c", 7),
        (8, "two", "de", "c", 3),
        (None, plain, None, "a", 1),
        (9, " ".join(f"w{i}" for i in range(60_000)), "en", "a", 1),
        (10, "é" * 50_000, "fr", "b", 1),
        (11, "<|endoftext|> \U0001f600 a​b token = \"abcdefgh12345678\"", "en", "d", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("x") for c in CLASH})
